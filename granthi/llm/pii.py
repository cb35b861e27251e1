"""Personal data by weak supervision, in DataFrame functions alone.

Patterns give candidates: spans of the base kinds, strings that fail a base kind's check, mail addresses and
telephone numbers in looser writing (``a (at) b.org``, ``(743) 555-0100``), and long mixed strings. Three labelers vote on each: a shape (regex and checksum) labeler, a gazetteer labeler and a
context labeler, which look at the value, at known lists, and at the words before it. The votes are
counted in Spark; expectation-maximisation on these counts (a few hundred rows at most, however large the input)
estimates each labeler's reliability, and its posteriors train a logistic span classifier, which adds spans.
Base spans always stay. What the shape labeler rejects is never added, whatever stands around it: an address with
a part over 255 or a number whose check digit fails is none. So spans can be added of the kinds email, phone and
secret, and of ip and card none beyond the base ones. Texts are read once and never enter a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collect_garbage, has_count, materialize, read_table

BASE = ("email", "ip", "card", "phone")
#: Kinds of candidates, and the kind of span that each gives.
KINDS = {"email": "email", "email_loose": "email", "ip": "ip", "card": "card", "phone": "phone", "phone_loose": "phone", "secret": "secret"}
ORDER = (*BASE, "secret")
# The base patterns. Possessive quantifiers and the look-behinds change no match: they keep the matcher from
# trying a failed run again at each of its characters, and from a stack as deep as the run is long.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_loose": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?+[(\[]at[)\]]\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|[(\[]dot[)\]])\x20?+[A-Za-z0-9-]++)++",
    "phone_loose": r"(?<![A-Za-z0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: What a text must hold (one of these) for the pattern to be worth trying.
NEEDS = {"email": ("@",), "phone": ("+",), "email_loose": ("(at)", "[at]", "(at]", "[at)")}
#: Characters before a span that the context labeler reads.
CONTEXT = 24
# The gazetteers.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "uk", "eu", "us", "np", "in", "ch", "at", "it", "nl")
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "private_key", "credential", "bearer", "authorization")
CUES = {
    "email": ("mail", "contact", "write to", "@"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "credit", "payment", "account", "iban"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "secret": ("=", ":", "key", "token", "secret", "password"),
}
CUES |= {"email_loose": CUES["email"], "phone_loose": CUES["phone"]}


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Whether the check digit holds: from the right, every second digit doubled and its digits summed."""
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10 = 0)"


def _base_test(kind: str) -> str:
    """Whether the match ``x.m`` is a base span."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(cast(right(p, 3) as int), 0) <= 255)"
    n = f"length({_digits('x.m')})"
    if kind == "phone":
        return f"({n} between 9 and 15)"
    if kind == "card":
        return f"({n} between 13 and 19 and {_luhn(_digits('x.m'))})"
    return "false"


def _is_candidate(kind: str) -> str:
    if kind == "card":
        return "(length(x.m) >= 13 and length(regexp_replace(x.m, '[^0-9]', '')) between 13 and 19)"
    if kind == "secret":
        return "(x.m rlike '[0-9]' and x.m rlike '[A-Za-z]')"
    return "true"


def _shape_vote(kind: str) -> str:
    """1 yes, 0 no, 2 no vote."""
    if kind == "secret":
        return "case when x.m rlike '^(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)$' then 1 when length(regexp_replace(x.m, '[^0-9]', '')) * 5 < length(x.m) then 0 else 2 end"
    if kind in ("email", "email_loose"):
        return "case when x.m rlike '[A-Za-z]{2,}+$' then 1 else 0 end"
    if kind == "phone_loose":
        return "2"
    return f"case when {_base_test(kind)} then 1 else 0 end"


def _list_vote(kind: str) -> str:
    if kind == "email_loose":
        return f"case when lower(regexp_extract(x.m, '[A-Za-z0-9-]+$', 0)) in ({', '.join(map(repr, TOP_LEVEL))}) then 1 else 2 end"
    if kind == "phone_loose":  # area and exchange codes begin with 2 to 9
        return "case when x.m rlike '^[(]?[2-9][0-9]{2}[^0-9]{1,2}[2-9]' then 1 else 0 end"
    if kind == "email":
        return f"case when lower(substring_index(x.m, '.', -1)) in ({', '.join(map(repr, TOP_LEVEL))}) then 1 else 2 end"
    if kind == "ip":
        return "case when substring_index(x.m, '.', 1) in ('0', '127', '255') then 0 when cast(right(substring_index(x.m, '.', 1), 3) as int) between 1 and 223 then 1 else 2 end"
    if kind == "card":
        return "case when substring(x.m, 1, 1) in ('3', '4', '5', '6') then 1 else 0 end"
    if kind == "phone":
        return "case when x.m rlike '^[+](?:1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])' then 1 else 0 end"
    return f"case when lower(x.g) rlike '(?:{'|'.join(SECRET_WORDS)})' then 1 when x.g = '' then 2 else 0 end"


def _context_vote(kind: str) -> str:
    return f"case when {' or '.join(f'contains(lower(x.g), {c!r})' for c in CUES[kind])} then 1 else 2 end"


#: Elements that a running total goes through at once: appending to an array copies it, so long arrays are cut into such blocks.
SCAN = 256


def _before(values: str, step: str) -> str:
    """Array of what ``step`` (of ``a`` and ``b``, from 0) makes of all elements before each one of an array of integers."""
    whole = lambda array, start: f"""aggregate({array}, named_struct('at', {start}, 'out', cast(array() as array<int>)), (acc, b) ->
        named_struct('at', {step.format(a="acc.at", b="b")}, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"""  # noqa: E731
    total = f"aggregate(part, 0, (acc, b) -> {step.format(a='acc', b='b')})"
    blocks = f"transform(sequence(0, (size(v) - 1) div {SCAN}), k -> slice(v, k * {SCAN} + 1, {SCAN}))"
    starts = whole(f"transform(parts, part -> {total})", 0)
    cut = f"element_at(transform(array({blocks}), parts -> flatten(zip_with(parts, {starts}, (part, start) -> {whole('part', 'start')}))), 1)"
    return f"element_at(transform(array({values}), v -> if(size(v) <= {SCAN}, {whole('v', 0)}, {cut})), 1)"


def _candidates(kind: str, text: str) -> Column:
    """Array of the kind's candidates in ``text``, with offsets in code points, votes and features."""
    p = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    found = f"zip_with(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0), (gap, m) -> struct(length(gap) as l, right(gap, {CONTEXT}) as g, m as m))"
    out = "struct<kind:string,s:int,e:int,base:boolean,v1:int,v2:int,v3:int,size:int,digits:int>"
    item = f"""named_struct('kind', '{kind}', 's', at + x.l, 'e', at + x.l + length(x.m), 'base', {_base_test(kind)},
        'v1', {_shape_vote(kind)}, 'v2', {_list_vote(kind)}, 'v3', {_context_vote(kind)},
        'size', cast(least(length(x.m) div 8, 7) as int), 'digits', cast(length(regexp_replace(x.m, '[^0-9]', '')) * 4 div length(x.m) as int))"""
    places = _before("transform(found, x -> x.l + coalesce(length(x.m), 0))", "{a} + {b}")
    items = f"filter(zip_with(found, {places}, (x, at) -> if(x.m is not null and {_is_candidate(kind)}, {item}, null)), c -> c is not null)"
    none = f"cast(array() as array<{out}>)"
    walk = f"element_at(transform(array({found}), found -> if(size(found) < 2, {none}, {items})), 1)"  # without a match there is one gap
    return F.expr(f"if({' or '.join(f'contains({text}, {x!r})' for x in NEEDS[kind])}, {walk}, {none})" if kind in NEEDS else walk)


def _free(loose: str, kind: str) -> str:
    """The loose candidates that overlap no base span. Base spans are in order and apart, so of those that begin before a candidate ends the last one tells; it is found by halving."""
    begun = """aggregate(sequence(1, 31), named_struct('lo', 0, 'hi', size(spans)), (acc, k) -> if(acc.lo >= acc.hi, acc,
        if(spans[(acc.lo + acc.hi) div 2].s < c.e, named_struct('lo', cast((acc.lo + acc.hi) div 2 + 1 as int), 'hi', acc.hi), named_struct('lo', acc.lo, 'hi', cast((acc.lo + acc.hi) div 2 as int)))), acc -> acc.lo)"""
    apart = f"filter({loose}, c -> coalesce(element_at(transform(array({begun}), n -> if(n = 0, true, spans[n - 1].e <= c.s)), 1), true))"
    return f"if(size({loose}) = 0, {loose}, element_at(transform(array(filter({kind}, b -> b.base)), spans -> if(size(spans) = 0, {loose}, {apart})), 1))"


def candidates(docs: DataFrame) -> DataFrame:
    """(kept, found) for each row of ``docs``: the whole row as a struct, and its candidates; null texts are empty and have none.

    The row stays in one struct, so that no name of its columns can clash with one used here. A loose candidate
    that overlaps a base span of its kind is left out. The work grows in proportion to the text and its spans.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"))
    whole = rows.select("kept", F.coalesce(F.col("kept.text"), F.lit("")).alias("whole"))
    parts = whole.select("kept", *(_candidates(k, "whole").alias(k) for k in KINDS))
    return parts.select("kept", F.concat(*(F.expr(_free(k, KINDS[k])) if k.endswith("_loose") else F.col(k) for k in KINDS)).alias("found"))


Pattern = tuple[str, int, int, int, int, int]  # kind of candidate, three votes, size, share of digits


def reliabilities(counts: dict[Pattern, int], rounds: int = 50) -> tuple[dict[str, float], list[list[list[float]]], dict[Pattern, float]]:
    """Expectation-maximisation over vote patterns: each kind's share of true spans, each labeler's votes given
    the truth, and the posterior of each pattern. It starts from the share of yes among the votes cast."""
    kinds = sorted({p[0] for p in counts})
    posterior = {}
    for p in counts:
        cast = [v for v in p[1:4] if v < 2]
        posterior[p] = min(max(sum(cast) / len(cast), 0.05), 0.95) if cast else 0.3
    share: dict[str, float] = {}
    votes: list[list[list[float]]] = []
    for _ in range(rounds):
        for kind in kinds:
            n = sum(c for p, c in counts.items() if p[0] == kind)
            share[kind] = (1 + sum(c * posterior[p] for p, c in counts.items() if p[0] == kind)) / (2 + n)
        votes = []
        for k in range(3):
            table = [[1.0] * 3, [1.0] * 3]
            table[1][1] += 2.0  # a labeler is taken to be better than chance
            table[0][0] += 2.0
            for p, c in counts.items():
                table[1][p[1 + k]] += c * posterior[p]
                table[0][p[1 + k]] += c * (1 - posterior[p])
            votes.append([[x / sum(row) for x in row] for row in table])
        for p in counts:
            yes, no = math.log(share[p[0]]), math.log(1 - share[p[0]])
            for k in range(3):
                yes += math.log(votes[k][1][p[1 + k]])
                no += math.log(votes[k][0][p[1 + k]])
            posterior[p] = 1 / (1 + math.exp(min(max(no - yes, -50.0), 50.0)))
    return share, votes, posterior


def _names(p: Pattern) -> list[str]:
    kind, v1, v2, v3, size, digits = p
    return ["bias", f"kind={kind}", f"v1={v1}", f"v2={v2}", f"v3={v3}", f"{kind}:v1={v1}", f"{kind}:v2={v2}", f"size={size}", f"digits={digits}"]


def train_classifier(counts: dict[Pattern, int], posterior: dict[Pattern, float], rounds: int = 300) -> dict[str, float]:
    """Logistic regression on the posteriors, by gradient steps over the distinct patterns."""
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    total = sum(counts.values()) or 1
    rows = [(_names(p), c / total, posterior[p]) for p, c in sorted(counts.items())]
    for _ in range(rounds):
        gradient: dict[str, float] = {}
        for names, share, target in rows:
            z = sum(weights.get(n, 0.0) for n in names)
            error = share * (1 / (1 + math.exp(-min(max(z, -30.0), 30.0))) - target)
            for n in names:
                gradient[n] = gradient.get(n, 0.0) + error
        for n, g in gradient.items():
            g += 1e-5 * weights.get(n, 0.0)
            seen[n] = seen.get(n, 1e-8) + g * g
            weights[n] = weights.get(n, 0.0) - 0.5 * g / math.sqrt(seen[n])
    return weights


def learn(found: DataFrame, column: str = "found") -> dict[str, float]:
    """The classifier's weights, from the votes on all candidates of ``found``."""
    c = found.select(F.explode(column).alias("c")).select("c.kind", "c.v1", "c.v2", "c.v3", "c.size", "c.digits")
    collect_garbage(found.sparkSession)
    rows = c.groupBy(*c.columns).agg(F.count("*").alias("n")).collect()  # at most 7 kinds, 27 votes, 8 sizes and 5 shares of digits
    counts = {tuple(r[:6]): r["n"] for r in rows}
    return train_classifier(counts, reliabilities(counts)[2]) if counts else {}


def spans(column: str, weights: dict[str, float]) -> Column:
    """Of an array of candidates those that are base spans, or that the classifier accepts and the shape labeler does not reject."""
    if not weights:
        return F.expr(f"filter({column}, c -> c.base)")
    table = "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in sorted(weights.items())) + ")"
    names = ["'bias'", "concat('kind=', c.kind)", "concat('v1=', c.v1)", "concat('v2=', c.v2)", "concat('v3=', c.v3)", "concat(c.kind, ':v1=', c.v1)", "concat(c.kind, ':v2=', c.v2)", "concat('size=', c.size)", "concat('digits=', c.digits)"]
    z = " + ".join(f"coalesce(try_element_at({table}, {n}), 0D)" for n in names)
    return F.expr(f"filter({column}, c -> c.base or (c.v1 <> 0 and ({z}) >= 0))")


def _named(column: str) -> str:
    """Spans (kind, s, e, base) by the kind that they give."""
    names = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in KINDS.items()) + ")"
    return f"transform({column}, c -> named_struct('kind', element_at({names}, c.kind), 's', c.s, 'e', c.e, 'base', c.base))"


def _joined(column: str) -> str:
    place = f"cast(array_position(array({', '.join(map(repr, ORDER))}), c.kind) as int)"
    ordered = f"array_sort(transform({column}, c -> named_struct('place', {place}, 's', c.s, 'e', c.e, 'kind', c.kind)))"  # by the fields in their order
    return f"array_join(transform({ordered}, c -> concat(c.kind, ':', c.s, ':', c.e)), ',')"


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The numbers and the digest are of base spans. Offsets are code points, ends exclusive; spans stand by kind,
    then start. Null and empty texts have none. Repeated rows repeat; an empty table gives an empty result; columns
    other than doc_id and text are ignored.
    """
    found = materialize(candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("kept.doc_id", "found"), "candidates")
    chosen = found.select("doc_id", spans("found", learn(found)).alias("chosen")).select("doc_id", F.expr(_named("chosen")).alias("chosen"))
    with_base = chosen.withColumn("base", F.expr("filter(chosen, c -> c.base)"))
    counted = [F.expr(f"cast(size(filter(base, c -> c.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return with_base.select("doc_id", *counted, F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_joined("chosen")).alias("spans"))


#: From so many spans on a text is cut as an array of its characters: one pass, however many cuts.
MANY_SPANS = 64


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in angle brackets.

    All other columns, whatever their names, rows and null texts stay; ``n_chars``, where there is one of whole numbers, follows a
    changed text. Where spans overlap, the one that begins first (of those the longest) is replaced, and of a
    later one what stands beyond it. Texts are searched once: rows are written with their candidates, from which
    the classifier learns and texts are then made. An empty table gives an empty result.
    """
    found = materialize(candidates(docs), "candidates")
    chosen = found.select("kept", spans("found", learn(found)).alias("chosen"))
    marked = chosen.select("kept", F.expr(_named("chosen")).alias("spans"))
    ordered = marked.select("kept", F.expr("array_sort(transform(spans, c -> named_struct('s', c.s, 'back', -c.e, 'kind', c.kind)))").alias("spans"))
    # what is kept before each span, and the span's kind; the end of the last span
    ends = _before("transform(spans, c -> -c.back)", "greatest({a}, {b})")
    parts = f"filter(zip_with(spans, {ends}, (c, at) -> named_struct('a', at, 'b', greatest(c.s, at), 'kind', c.kind, 'e', -c.back)), p -> p.e > p.a)"
    cuts = f"named_struct('at', coalesce(array_max(transform(spans, c -> -c.back)), 0), 'parts', {parts})"
    cut = ordered.select("kept", F.size("spans").alias("n"), F.expr(cuts).alias("cut"))
    few = "concat(array_join(transform(cut.parts, p -> concat(substring(kept.text, p.a + 1, p.b - p.a), '<', p.kind, '>')), ''), substring(kept.text, cut.at + 1, length(kept.text)))"
    many = """element_at(transform(array(split(kept.text, '')), chars -> concat(array_join(transform(cut.parts, p -> concat(array_join(slice(chars, p.a + 1, p.b - p.a), ''), '<', p.kind, '>')), ''),
        array_join(slice(chars, cut.at + 1, size(chars)), ''))), 1)"""
    done = cut.select("kept", "n", F.expr(f"case when n = 0 or kept.text is null then kept.text when n < {MANY_SPANS} then {few} else {many} end").alias("new"))
    changed = {"text": F.col("new")}
    if has_count(docs):
        changed["n_chars"] = F.expr("if(n = 0, kept.n_chars, length(new))").cast(docs.schema["n_chars"].dataType)
    return done.select(*(changed.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(read_table(spark, sf_dir, "documents"))
