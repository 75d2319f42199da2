"""Personal data: rule-found spans that always stand, and boosted trees that select further candidates.

Everything on the data runs as SQL expressions, row by row and without a shuffle. Base spans (email,
ip, card, phone) come from fixed patterns and checks. High-recall generators propose further,
overlapping spans: disguised addresses, national phone numbers, personal numbers, account numbers,
long network addresses. Each gets format features of its own letters and context features of the
letters around it; boosted trees, written out as CASE expressions, score it. Trees and the
threshold of each kind are learned on the driver from a fixed, generated set of examples, whose
features the same expressions compute; the threshold is the least that reaches ``PRECISION`` on
examples, for and against, in a way of writing that the trees haven't seen. A candidate that meets a base span or a better candidate
gives way.

Defined cases: a null text is empty and has no spans; repeated rows are searched row by row; an
empty table gives an empty one; columns other than the two named are not read by ``find_pii`` and
passed on by ``redact``, whatever their names. Texts are searched whole; patterns are written so
that runs of one kind of letter, however long, are read once.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees

KINDS = ("email", "ip", "card", "phone", "disguised_email", "national_phone", "personal_number", "account", "ip6")
BASE = 4
#: Precision that a kind's threshold reaches on unseen examples, and letters of context on either side.
PRECISION, CONTEXT = 0.99, 24
#: Examples for and against each kind: in each way of writing that is learned from, and in that which sets the thresholds.
LEARNED, CALIBRATED = 80, 240

# A match may begin where its run of letters begins, or where the match before it ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of candidates: kind, condition on the text, pattern.
_GENERATORS = (
    (4, "text rlike r'(?i)[(\\[]at[)\\]]'", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[](?i:dot)[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,4}"),
    (5, "digit", r"(?<![0-9A-Za-z+.()-])[(]?[0-9]{2,4}[)]?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9A-Za-z])"),
    (6, "digit", r"(?<![0-9A-Za-z+.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])"),
    (7, "digit", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    (8, "digit and text like '%:%'", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
)


#: Code points of a block of text, by which spans are cut out, and of a cell, by which candidates find their neighbours: no candidate is longer than a cell.
BLOCK, CELL = 1024, 512


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound: the value is worked out once, however often (in lambdas too) the body uses it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(values: str, step: str, none: str) -> str:
    """Running ``step`` (of x, the earlier, and y) over an array of n whole numbers, in blocks of sqrt(n), as an array that grows is copied at each step."""
    joined = lambda x, y: re.sub(r"\b[xy]\b", lambda name: {"x": x, "y": y}[name[0]], step)
    within = f"aggregate(slice(v, i * w + 1, w), cast(array() as array<int>), (a, y) -> concat(a, array(if(size(a) = 0, y, {joined('element_at(a, -1)', 'y')}))))"
    blocks = f"transform(sequence(0, cast((size(v) - 1) div w as int)), i -> {within})"
    before = f"aggregate(t, array({none}), (a, u) -> concat(a, array({joined('element_at(a, -1)', 'element_at(u, -1)')})))"
    whole = f"flatten(zip_with(t, slice({before}, 1, size(t)), (u, x) -> transform(u, y -> {joined('x', 'y')})))"
    return _let("v", values, f"if(size(v) > 1, {_let('w', 'cast(ceil(sqrt(size(v))) as int)', _let('t', blocks, whole))}, v)")


def _found_spans(kinds: list[tuple[int, str, str]]) -> str:
    """An array of (k, s, e, m): the matches of all patterns in ``text`` with their places in code points."""
    pieces = ", ".join(f"named_struct('k', {kind}, 'm', case when {condition} then regexp_extract_all(text, r'{pattern}', 0) else cast(array() as array<string>) end, 'g', case when {condition} then split(text, r'{pattern}', -1) else cast(array() as array<string>) end)" for kind, condition, pattern in kinds)
    ends = _scan("zip_with(slice(p.g, 1, size(p.m)), p.m, (g, m) -> cast(length(g) + length(m) as int))", "x + y", "0")
    return f"flatten(transform(filter(array({pieces}), p -> size(p.m) > 0), p -> zip_with(p.m, {ends}, (m, e) -> named_struct('k', p.k, 's', e - length(m), 'e', e, 'm', m))))"


def _cut(blocks: str, begin: str, end: str) -> str:
    """The code points [begin, end) of a text in blocks: reads only the blocks that hold them."""
    some = f"array_join(slice({blocks}, cast(({begin}) div {BLOCK} as int) + 1, cast((greatest({end}, {begin} + 1) - 1) div {BLOCK} - ({begin}) div {BLOCK} as int) + 1), '')"
    return f"substring({some}, cast(({begin}) % {BLOCK} as int) + 1, ({end}) - ({begin}))"


#: The text in blocks.
_BLOCKS = f"regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    digit = f"cast(substring(reverse({_digits(m)}), i, 1) as int)"
    return f"aggregate(sequence(1, length({_digits(m)})), 0, (t, i) -> t + case when i % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end) % 10 = 0"


_KEPT = {
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": f"length({_digits('x.m')}) between 16 and 19 and {_luhn('x.m')}",
    "phone": f"length({_digits('x.m')}) between 8 and 15",
}

#: Context words, before a span, that speak for or against personal data.
_FOR = {4: "mail|contact|reach|write", 5: "phone|tel|call|mobile|cell|fax|contact|reach", 6: "ssn|social|security|personal|national|tax", 7: "iban|account|bank|konto|compte|cuenta", 8: "address|host|ip|peer|client"}
_AGAINST = "version|page|price|order|date|isbn|total|invoice|serial|part|model|article|section|item|from|since|until"
FEATURES = ("length(m)", f"length({_digits('m')})", f"length({_digits('m')}) / length(m)", "length(regexp_replace(m, '[^ ]', ''))", "length(regexp_replace(m, '[^.]', ''))", "length(regexp_replace(m, '[^-]', ''))", "length(regexp_replace(m, '[^/]', ''))", "cast(m like '(%' as int)", "cast(m rlike '^[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$' as int)", "cast(m rlike '(19|20)[0-9]{2}' as int)", "cast(m rlike '^(000|666|9)' as int)", *(f"cast(lower(before) rlike '({words})[^a-z]{{0,3}}([a-z]{{0,6}}[^a-z]{{0,3}})?$' as int)" for words in _FOR.values()), f"cast(lower(before) rlike '({_AGAINST})[^a-z]{{0,3}}([a-z]{{0,6}}[^a-z]{{0,3}})?$' as int)", "cast(after rlike '^[ ]?([%$€£°]|kg|km|mm|eur|usd)' as int)", "cast(before rlike '[$€£#=]$' as int)", "cast(after rlike '^[./:-]?[0-9]' as int)")


def _features(m: str, before: str, after: str) -> list[str]:
    names = {"m": m, "before": before, "after": after}
    return [re.sub(r"(?<![\w'(|^\[])\b(m|before|after)\b(?=[ ,)])|(?<=\()\b(m|before|after)\b(?=[ ,)])", lambda x: names[x[1] or x[2]], f) for f in FEATURES]


#: Ways of writing that examples differ by: letters of words, what stands between a context word and a span, what follows a span,
#: forms of phone numbers (# a digit), joints of disguised addresses, ends of host names, countries. Trees learn from all but the last.
_STYLES = (
    ("etaoinshrdlu", (": ", " ", " is "), (" ", ".", ", "), ("(###) ###-####", "###-###-####"), (("(at)", "(dot)"), ("[at]", "[dot]")), ("com", "org"), ("DE", "FR")),
    ("abcdefghijklmnopqrstuvwxyz", (" - ", " = ", ": "), ("\n", ";", ")"), ("###.###.####", "### ### ####"), (("(at)", "."), ("[at]", ".")), ("de", "net"), ("GB", "ES")),
    ("aeioulnrst", (" (", " no ", " "), (" or ", "!", " "), ("###-###-####", "### ###-####", "(##) ####-####"), (("(AT)", "(DOT)"), ("[at]", " [dot]")), ("io", "info"), ("IT", "NL")),
    ("bcdfghaeiou", (": ", " is ", ", "), (".", " but ", "?"), ("(###) ###-####", "###.###.####", "####-####-###"), (("(at)", "[dot]"), ("[AT]", ".")), ("edu", "fr"), ("CH", "AT")),
)


def _examples(style: int, each: int, seed: int = 11) -> list[tuple[int, str, str, str, int]]:
    """(kind, span, before, after, label): generated examples in one way of writing, as many for as against each kind."""
    r = random.Random(seed * 31 + style)
    letters, glue, ends, phones, joints, tops, countries = _STYLES[style]
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    pick = r.choice
    number = lambda form: "".join(d(1) if c == "#" else c for c in form)
    names = {k: v.split("|") for k, v in _FOR.items()}
    against = _AGAINST.split("|")

    def good(kind: int) -> str:
        if kind == 4:
            at, dot = pick(joints)
            return f"{w()}{pick(['.', '_', ''])}{w()}{pick([' ', ''])}{at} {w()} {dot} {pick(tops)}".replace(" . ", ".")
        if kind == 5:
            return number(pick(phones))
        if kind == 6:
            return f"{r.randint(100, 665)}{(c := pick('- '))}{d(2)}{c}{d(4)}"
        if kind == 7:
            return f"{pick(countries)}{d(2)}" + "".join(f" {d(4)}" for _ in range(r.randint(4, 5))) + pick(["", " " + d(2)])
        return ":".join(f"{r.randrange(65536):x}" for _ in range(8))

    def bad(kind: int) -> str:
        if kind == 4:
            return f"{w()} {pick(joints)[0]} {w()}.{w()}"
        if kind == 5:
            return pick([number(pick(phones)), f"{d(2)}.{d(4)}.{d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)}/{d(3)}/{d(4)}", f"{r.randint(1900, 2030)}-{d(3)}-{d(3)}"])
        if kind == 6:
            return pick([f"{pick(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {pick(['19', '20'])}{d(2)}", f"{d(3)}-{d(2)}-{d(4)}"])
        if kind == 7:
            return "".join(pick("ABCDEFGHJK") for _ in range(2)) + d(2) + "".join(" " * pick([0, 1]) + "".join(pick("ABCDEF0123456789") for _ in range(4)) for _ in range(pick([2, 3])))
        return ":".join(d(2) for _ in range(pick([6, 7])))

    out = []
    for _ in range(each):
        for kind in _FOR:
            lead = f"{w()} {pick(names[kind])}{pick(glue)}" if r.random() < 0.85 else f"{w()} {w()} "
            out.append((kind, good(kind), lead, pick(ends) + w(), 1))
            lead = f"{w()} {pick(against)}{pick(glue)}" if r.random() < 0.7 else f"{w()} {w()} "
            out.append((kind, bad(kind), lead, pick([*ends, " kg ", " % ", "/" + d(2)]) + w(), 0))
    return out


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _measured(session: SparkSession, rows: list[tuple[int, str, str, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The trees' inputs, by the expressions that serve the data, and labels."""
    values = ", ".join(f"({k}, {_literal(m)}, {_literal(b)}, {_literal(a)}, {y})" for k, m, b, a, y in rows)
    columns = ", ".join(f"cast({f} as double) f{i}" for i, f in enumerate(_features("m", "before", "after")))
    got = session.sql(f"select cast(k as double) k, cast(y as double) y, {columns} from values {values} as t(k, m, before, after, y)").collect()
    data = np.array([tuple(r) for r in got])
    return data[:, [0, *range(2, data.shape[1])]], data[:, 1]


@functools.lru_cache(maxsize=1)
def _learned(session: SparkSession) -> tuple[trees.Trees, dict[int, float]]:
    """Trees and the threshold of each kind, the least that reaches the precision on a way of writing that the trees haven't seen. A kind that can't reach it selects nothing."""
    parts = [_measured(session, _examples(style, LEARNED)) for style in range(len(_STYLES) - 1)]
    model = trees.train(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]), trees=16, depth=3, rate=0.4, bins=24)
    x, y = _measured(session, _examples(len(_STYLES) - 1, CALIBRATED))
    p = model.probability(x)
    thresholds = {}
    for kind in _FOR:
        own = x[:, 0] == kind
        order = np.argsort(-p[own], kind="stable")
        score, right = p[own][order], np.cumsum(y[own][order])
        good = [i for i in range(len(score)) if right[i] / (i + 1) >= PRECISION and (i + 1 == len(score) or score[i + 1] < score[i])]
        thresholds[kind] = max(0.5, float(score[good[-1]])) if good else 2.0
    return model, thresholds


def _margin(model: trees.Trees, names: list[str]) -> str:
    """The trees as one SQL expression."""

    def node(t: int, i: int, depth: int) -> str:
        if depth == model.depth:
            return f"{model.leaf[t][i - 2**model.depth + 1]:.9e}D"
        cut = model.cut[t][i]
        if np.isinf(cut):
            return node(t, 2 * i + 1, depth + 1)
        return f"case when {names[model.feature[t][i]]} <= {cut:.9e}D then {node(t, 2 * i + 1, depth + 1)} else {node(t, 2 * i + 2, depth + 1)} end"

    return " + ".join([f"{model.base:.9e}D", *(node(t, 0, 0) for t in range(len(model.leaf)))])


def _apart_from(base: str, candidates: str) -> str:
    """The candidates that meet no base span: all are put in order, and each looks at the furthest end before it and the nearest begin after it."""
    order = "named_struct('s', x.s, 'o', {o}, 'e', x.e, 'k', x.k, 'm', {m})"
    both = f"array_sort(concat(transform(b, x -> {order.format(o=0, m=repr(''))}), transform(c, x -> {order.format(o=1, m='x.m')})))"
    ends = _scan("transform(a, x -> if(x.o = 0, x.e, 0))", "greatest(x, y)", "0")
    begins = f"reverse({_scan('reverse(transform(a, x -> if(x.o = 0, x.s, 2147483647)))', 'least(x, y)', '2147483647')})"
    free = "filter(zip_with(a, zip_with(p, n, (p, n) -> named_struct('p', p, 'n', n)), (x, y) -> named_struct('x', x, 'p', y.p, 'n', y.n)), x -> x.x.o = 1 and x.p <= x.x.s and x.n >= x.x.e)"
    apart = _let("a", both, _let("p", ends, _let("n", begins, f"transform({free}, x -> named_struct('k', x.x.k, 's', x.x.s, 'e', x.x.e, 'm', x.x.m))")))
    return _let("b", base, _let("c", candidates, f"if(size(b) = 0 or size(c) = 0, c, {apart})"))


def _best(candidates: str) -> str:
    """The candidates that no better one meets. Candidates are in order of their begins, and each looks at its own cell and those beside it."""
    better = "b.s < x.e and x.s < b.e and (b.z > x.z or (b.z = x.z and (b.s < x.s or (b.s = x.s and (b.e > x.e or (b.e = x.e and b.k < x.k))))))"
    cell = f"element_at(c, {{}}).s div {CELL}"
    first = _scan(f"transform(c, (x, i) -> if(i = 0 or x.s div {CELL} <> {cell.format('i')}, i, 0))", "greatest(x, y)", "0")
    last = f"reverse({_scan(f'reverse(transform(c, (x, i) -> if(i + 1 = size(c) or x.s div {CELL} <> ' + cell.format('i + 2') + ', i, 2147483647)))', 'least(x, y)', '2147483647')})"
    # Places count from 0; the cell before ends right before this one's first, the cell after begins right after its last.
    low = f"if(element_at(f, i + 1) > 0 and {cell.format('element_at(f, i + 1)')} = x.s div {CELL} - 1, element_at(f, element_at(f, i + 1)), element_at(f, i + 1))"
    high = f"if(element_at(l, i + 1) + 1 < size(c) and {cell.format('element_at(l, i + 1) + 2')} = x.s div {CELL} + 1, element_at(l, element_at(l, i + 1) + 2), element_at(l, i + 1))"
    near = f"slice(c, {low} + 1, {high} - {low} + 1)"
    kept = _let("f", first, _let("l", last, f"filter(c, (x, i) -> not exists({near}, b -> {better}))"))
    return _let("c", f"array_sort({candidates})", f"if(size(c) < 2, c, {kept})")


def _found(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text) and arrays of spans (k, s, e): base, extra."""
    model, thresholds = _learned(rows.sparkSession)
    columns = rows.columns
    rows = rows.selectExpr("*", "text rlike '[0-9]' as digit")
    base = [(0, "text like '%@%'", _EMAIL), (1, "digit", _IP), (2, "digit", _CARD), (3, "digit and text like '%+%'", _PHONE)]
    rows = rows.selectExpr(*columns, f"{_found_spans([*base, *_GENERATORS])} as found")
    right = " ".join(f"when {KINDS.index(k)} then {condition}" for k, condition in _KEPT.items())
    rows = rows.selectExpr(*columns, f"transform(filter(found, x -> x.k < {BASE} and case x.k {right} else true end), x -> named_struct('k', x.k, 's', x.s, 'e', x.e)) as base", f"filter(found, x -> x.k >= {BASE}) as candidates")
    before, after = _cut("blocks", f"greatest(0, c.s - {CONTEXT})", "c.s"), _cut("blocks", "c.e", f"(c.e + {CONTEXT})")
    around = f"transform(candidates, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'm', c.m, 'before', {before}, 'after', {after}))"
    rows = rows.selectExpr(*columns, "base", f"{_let('candidates', _apart_from('base', 'candidates'), f'if(size(candidates) = 0, cast(array() as array<struct<k: int, s: int, e: int, m: string, before: string, after: string>>), ' + _let('blocks', _BLOCKS, around) + ')')} as candidates")
    named = ", ".join(f"'f{i}', cast({f} as double)" for i, f in enumerate(_features("c.m", "c.before", "c.after")))
    measured = f"transform(candidates, c -> named_struct('k', c.k, 's', c.s, 'e', c.e, 'k0', cast(c.k as double), {named}))"
    names = ["c.k0", *(f"c.f{i}" for i in range(len(FEATURES)))]
    cut = "case c.k " + " ".join(f"when {k} then {np.log(t / (1 - t)) if t < 1 else 1e9:.9e}D" for k, t in thresholds.items()) + " end"
    scored = f"filter(transform({measured}, c -> named_struct('s', c.s, 'e', c.e, 'k', c.k, 'z', {_margin(model, names)} - ({cut}))), c -> c.z >= 0)"
    return rows.selectExpr(*columns, "base", f"array_sort(transform({_best(scored)}, c -> named_struct('k', c.k, 's', c.s, 'e', c.e))) as extra")


def _written(spans: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({kinds}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra, base and extra (arrays of kind number, start, end in code points) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = [f"cast(size(filter(base, x -> x.k = {k})) as long) as n_{KINDS[k]}" for k in range(BASE)]
    return _found(rows).selectExpr("doc_id", *counts, f"sha2({_written('base')}, 256) as base_sha256", f"{_written('concat(base, extra)')} as spans", "cast(size(extra) as long) as n_extra", "base", "extra")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; all columns as they were, a null text stays null.

    Spans that overlap (two base kinds may) are replaced together, by the kind of the first.
    """
    columns = docs.columns
    rows = _found(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    # Each span knows how far those before it reach; one that begins before that is replaced with them.
    reach = _scan("transform(o, x -> x.e)", "greatest(x, y)", "0")
    stay = "filter(zip_with(o, concat(array(0), slice(r, 1, size(r) - 1)), (x, p) -> named_struct('s', x.s, 'k', x.k, 'p', p)), x -> x.s >= x.p)"
    pieces = f"transform({stay}, x -> concat({_cut('blocks', 'x.p', 'x.s')}, '[', element_at(array({kinds}), x.k + 1), ']'))"
    end = "element_at(r, size(r))"
    clean = _let("o", "array_sort(transform(concat(base, extra), x -> named_struct('s', x.s, 'e', x.e, 'k', x.k)))", _let("r", reach, _let("blocks", _BLOCKS, f"concat(array_join({pieces}, ''), {_cut('blocks', end, 'length(text)')})")))
    rows = rows.selectExpr("row", f"case when size(base) + size(extra) = 0 then text else {clean} end as clean")
    return rows.select(*(F.when(F.col("row").getField(c).isNotNull(), F.col("clean")).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns))
