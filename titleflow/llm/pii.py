"""Personal data: base patterns, and boosted trees over further candidates.

Base spans are those of a kind's pattern that pass the kind's check. Generators with looser or tighter patterns
propose more, overlapping spans, as where a phone number swallows the card behind it and fails. Candidates
are described by format and context in few small numbers, so a whole corpus sums up to a table of cells of bounded
size. Trees are boosted on that table, on candidates that a base span confirms or a rule refutes, and become
SQL expressions; a threshold for each kind, calibrated to a precision, selects further spans. Everything stays in the
row of its document, so no key or copy gathers anywhere.

Positions come from splitting a text at a pattern: the pieces between matches and the matches add up to them. Nothing
compares every span with every other: spans are sorted, and what precedes each is summed up by parts of about the root of their
number, so a text of 100,000 addresses takes seconds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleflow.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Fixed patterns of the base spans. Each begins where a leftmost search would, at a run's first character or
#: the end of the previous match, and does not step back, so long runs take linear time. A card's pattern asks for
#: the digits its check needs, as shorter runs fail anyway.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"(?:\G|(?<![0-9])(?<![0-9][\x20-]))[0-9](?:[\x20-]?[0-9]){13,}+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further generators: (kind, pattern).
GENERATORS = (
    (EMAIL, r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,63}+){1,8}+"),
    (IP, r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?![0-9.])"),
    (CARD, r"(?<![0-9])[0-9]{14,19}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![0-9])"),
    (PHONE, r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    (PHONE, r"(?<![0-9])00[0-9]{1,3}[\x20.-]\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])"),
)
#: Words before a candidate that speak for it.
TRIGGERS = r"(?i)(?:mail|phone|tel|call|fax|mobile|card|visa|contact|host|server|addr)[^a-z]{0,12}$"
CONTEXT = 24

FEATURES = ("generator", "digits", "check", "before", "after", "separators", "trigger")
#: Boosting rounds, splits from root to leaf, step, and the precision that thresholds are calibrated to.
ROUNDS, DEPTH, RATE, PRECISION = 30, 3, 0.3, 0.97

#: Pieces before a match that its context may reach into; a match has four characters at least.
REACH = CONTEXT // 4
#: Further spans that can overlap one of them, on each side: the longest has some 700 characters, and the shortest of every
#: generator follow each other in these.
NEAR = 320

_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
_SHIFT = 1 << 31


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, zero: Column, kind: str, merge) -> Column:
    """For every element, what ``merge``, an associative function, makes of ``zero`` and all elements before it.

    An array is appended to in parts of about the root of its length only, each from the sum of the parts before it.
    """
    none = F.array().cast(f"array<{kind}>")

    def parts(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: F.slice(v, b * width + 1, width))

    def firsts(parts: Column) -> Column:
        return _let(F.transform(parts, lambda part: F.aggregate(part, zero, merge)), lambda sums: F.transform(
            F.sequence(F.lit(1), F.size(sums)), lambda b: F.aggregate(F.slice(sums, F.lit(1), b - 1), zero, merge)))

    def step(state: Column, x: Column) -> Column:
        return F.struct(merge(state.at, x).alias("at"), F.concat(state.out, F.array(state.at)).alias("out"))

    def filled(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, firsts(parts), lambda part, first: F.aggregate(
            part, F.struct(first.alias("at"), none.alias("out")), step, lambda state: state.out)))

    return F.when(F.size(values) == 0, none).otherwise(_let(values, lambda v: _let(parts(v), filled)))


def _positions(text: Column, pattern: str) -> Column:
    """All leftmost matches as ``start, end, match``, in code points, with ``CONTEXT`` characters before and one after them."""
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda match, gap: F.struct(match.alias("match"), gap.alias("gap"), F.length(gap).alias("skip"), F.coalesce(F.length(match), F.lit(0)).alias("length")))

    def context(own: Column, pair: Column, k: Column) -> Column:
        pieces = [F.coalesce(F.right(F.get(own, k - back)[name], F.lit(CONTEXT)), F.lit("")) for back in range(REACH, 0, -1) for name in ("gap", "match")]
        return F.right(F.when(pair.skip >= CONTEXT, pair.gap).otherwise(F.concat(*pieces, pair.gap)), F.lit(CONTEXT))

    def following(own: Column, k: Column) -> Column:
        pieces = [F.coalesce(F.left(F.get(own, k + 1)[name], F.lit(1)), F.lit("")) for name in ("gap", "match")]
        return F.left(F.concat(*pieces), F.lit(1))

    def placed(own: Column) -> Column:
        passed = _before(F.transform(own, lambda p: p.skip + p.length), F.lit(0), "int", lambda a, b: a + b)
        spans = _let(passed, lambda at: F.transform(own, lambda p, k: F.struct(
            (F.get(at, k) + p.skip).alias("start"), (F.get(at, k) + p.skip + p.length).alias("end"), p.match.alias("match"),
            context(own, p, k).alias("before"), following(own, k).alias("after"))))
        return F.filter(spans, lambda s: s.match.isNotNull())

    return F.when(F.size(pairs) < 2, F.array().cast(_SPAN)).otherwise(_let(pairs, placed))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, at, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(at % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: int, match: Column) -> Column:
    """The check of a kind."""
    count = F.length(_digits(match))
    if kind == IP:
        parts = F.transform(F.split(F.regexp_replace(match, r"[\[\]]", ""), r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == CARD:
        return count.between(14, 19) & F.when(count.between(14, 19), _luhn(match)).otherwise(False)
    if kind == PHONE:
        return count.between(10, 15)
    return F.lit(True)


def _guard(kind: int, generator: int, text: Column) -> Column:
    """What a text needs for any candidate of a kind; for base cards a match itself, as their digits may all stand apart."""
    if kind == EMAIL:
        return text.contains("@") | text.contains("(at)") | text.contains("[at]")
    if kind == IP:
        return text.rlike(r"[0-9][.\[]")
    if kind == PHONE:
        return text.contains("+") | text.contains("00")
    return text.rlike("[0-9]{4}") if generator else text.rlike(BASE[CARD])


def _candidates(text: Column) -> Column:
    """``start, end, kind, generator, match, valid, before, after`` of all patterns' matches, base patterns first.

    ``generator`` is 0 for a base pattern.
    """
    patterns = [(kind, pattern, 0) for kind, pattern in BASE.items()]
    patterns += [(kind, pattern, number) for number, (kind, pattern) in enumerate(GENERATORS, start=1)]

    def of(kind: int, pattern: str, generator: int) -> Column:
        found = F.when(_guard(kind, generator, text), _positions(text, pattern)).otherwise(F.array().cast(_SPAN))
        return F.transform(found, lambda s: F.struct(
            s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("kind"), F.lit(generator).alias("generator"),
            s.match.alias("match"), _valid(kind, s.match).alias("valid"), s.before.alias("before"), s.after.alias("after")))

    return F.concat(*(of(*p) for p in patterns))


def _neighbour(char: Column) -> Column:
    """0 nothing or space, 1 punctuation, 2 letter or underscore, 3 digit, 4 signs of assignment and quotes."""
    return (
        F.when((char == "") | char.rlike(r"[\s]"), 0).when(char.rlike(r"[=:\"'/\\]"), 4).when(char.rlike("[0-9]"), 3)
        .when(char.rlike(r"[\p{L}_]"), 2).otherwise(1)
    )


def _features(c: Column) -> Column:
    count = F.length(_digits(c.match))
    steps = F.when(count < 8, 0)
    for level, most in enumerate((9, 11, 13, 15, 16, 19), start=1):
        steps = steps.when(count <= most, level)
    separators = F.array_size(F.array_distinct(F.regexp_extract_all(c.match, F.lit(r"[\x20().\[\]-]"), F.lit(0))))
    return F.struct(
        c.kind.alias("kind"), c.generator.alias("generator"), steps.otherwise(7).alias("digits"), c.valid.cast("int").alias("check"),
        _neighbour(F.substring(c.before, -1, 1)).alias("before"), _neighbour(c.after).alias("after"),
        F.least(separators, F.lit(3)).alias("separators"), c.before.rlike(TRIGGERS).cast("int").alias("trigger"))


def _described(df: DataFrame) -> DataFrame:
    """Adds ``candidates`` and ``base``, the valid spans of the base patterns in order, to rows with a ``text``.

    Candidates come by place. Each has the ``last`` base span of every kind that starts no later than it, as start * 2 ** 31 + end, -1
    for none, and the start of the ``next`` one of any kind behind it. Base spans of one kind do not overlap, so no other
    ones can overlap or hold the candidate.
    """
    found = df.withColumn("found", _candidates(F.col("text")))
    own = ("kind", "generator", "end", "match", "valid", "before", "after")
    found = found.withColumn("found", F.array_sort(F.transform("found", lambda c: F.struct(
        c.start.alias("start"), F.when((c.generator == 0) & c.valid, 0).otherwise(1).alias("rank"), *(c[n].alias(n) for n in own)))))
    kinds = range(len(KINDS))
    place = F.transform("found", lambda c: F.struct(*(
        F.when((c.rank == 0) & (c.kind == k), c.start.cast("bigint") * _SHIFT + c.end).otherwise(F.lit(-1).cast("bigint")).alias(f"k{k}") for k in kinds)))
    nothing = F.struct(*(F.lit(-1).cast("bigint").alias(f"k{k}") for k in kinds))
    last = _before(place, nothing, "struct<" + ",".join(f"k{k}:bigint" for k in kinds) + ">",
                   lambda a, b: F.struct(*(F.greatest(a[f"k{k}"], b[f"k{k}"]).alias(f"k{k}") for k in kinds)))
    starts = F.reverse(F.transform("found", lambda c: F.when(c.rank == 0, c.start).otherwise(F.lit(_SHIFT - 1).cast("int"))))
    following = F.reverse(_before(starts, F.lit(_SHIFT - 1).cast("int"), "int", lambda a, b: F.least(a, b)))
    pairs = F.zip_with(last, following, lambda a, b: F.struct(a.alias("last"), b.alias("next")))
    joined = F.zip_with("found", pairs, lambda c, p: F.struct(c.start.alias("start"), c.rank.alias("rank"), *(c[n].alias(n) for n in own), p.last.alias("last"), p.next.alias("next")))
    found = found.withColumn("candidates", joined)
    valid = F.filter("found", lambda c: c.rank == 0)
    return found.withColumn("base", F.transform(valid, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end")))).drop("found")


def _last_end(c: Column, kind: int) -> Column:
    """The end of the last base span of a kind, 0 for none."""
    key = c.last[f"k{kind}"]
    return F.when(key >= 0, key % _SHIFT).otherwise(0)


def _is_base(c: Column) -> Column:
    """The candidate is a base span, or has the place and kind of one."""
    key = c.start.cast("bigint") * _SHIFT + c.end
    own = F.lit(False)
    for kind in range(len(KINDS)):
        own = own | ((c.kind == kind) & (c.last[f"k{kind}"] == key))
    return (c.rank == 0) | own


def cells(df: DataFrame) -> DataFrame:
    """How many labelled candidates there are of each description: ``kind, *FEATURES, positive, negative``.

    1 for a candidate that is a base span; 0 for one that fails its kind's check, borders on a letter or lies in a
    base span of another kind. Others have no label. At most as many rows as there are descriptions.
    """

    def label(c: Column) -> Column:
        inside = F.lit(False)
        for kind in range(len(KINDS)):
            inside = inside | ((c.kind != kind) & (_last_end(c, kind) >= c.end))
        letter = F.substring(c.before, -1, 1).rlike(r"[\p{L}_]") | c.after.rlike(r"[\p{L}_]")
        return F.when(_is_base(c), 1).when(~c.valid | inside | letter, 0)

    seen = _described(df).select(F.explode(F.transform(
        "candidates", lambda c: F.struct(_features(c).alias("f"), label(c).alias("y")))).alias("x"))
    return seen.where("x.y IS NOT NULL").groupBy("x.f.kind", *(f"x.f.{name}" for name in FEATURES)).agg(
        F.sum(F.col("x.y").cast("bigint")).alias("positive"), F.sum(1 - F.col("x.y").cast("bigint")).alias("negative"))


@dataclass
class Trees:
    """``start`` and the trees' leaves add up to log-odds; a leaf is a number, a node (feature, most, low, high)."""

    start: float
    trees: list
    thresholds: list[float]

    def log_odds(self, features: Column) -> Column:
        def expression(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, most, low, high = node
            return F.when(features[name] <= most, expression(low)).otherwise(expression(high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + expression(tree)
        return total

    def value(self, features: dict[str, int]) -> float:
        total = self.start
        for node in self.trees:
            while not isinstance(node, float):
                name, most, low, high = node
                node = low if features[name] <= most else high
            total += node
        return total


def _grow(rows: list[tuple[dict, float, float]], depth: int):
    """One tree by Newton steps over rows of (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, gain = None, 1e-6
    if depth:
        for name in ("kind", *FEATURES):
            sums: dict[int, tuple[float, float]] = {}
            for f, a, b in rows:
                old = sums.get(f[name], (0.0, 0.0))
                sums[f[name]] = (old[0] + a, old[1] + b)
            left_g = left_h = 0.0
            for value in sorted(sums)[:-1]:
                left_g, left_h = left_g + sums[value][0], left_h + sums[value][1]
                now = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                if now > gain:
                    best, gain = (name, value), now
    if best is None:
        return -RATE * g / (h + 1)
    name, most = best
    return name, most, _grow([r for r in rows if r[0][name] <= most], depth - 1), _grow([r for r in rows if r[0][name] > most], depth - 1)


def boost(table: list[dict]) -> Trees:
    """Trees from the cells, and the lowest thresholds at which the labelled candidates reach the precision; a span must
    also be likelier than not. A kind without confirmed candidates gets a threshold that nothing meets."""
    table = sorted(table, key=lambda r: tuple(r[n] for n in ("kind", *FEATURES)))
    positive, negative = sum(r["positive"] for r in table), sum(r["negative"] for r in table)
    found = Trees(math.log((positive + 1) / (negative + 1)), [], [math.inf] * len(KINDS))
    values = [found.start] * len(table)
    for _ in range(ROUNDS if positive and negative else 0):
        rows = []
        for r, value in zip(table, values):
            p = 1 / (1 + math.exp(-value))
            n = r["positive"] + r["negative"]
            rows.append((r, n * p - r["positive"], n * p * (1 - p)))
        tree = _grow(rows, DEPTH)
        found.trees.append(tree)
        one = Trees(0.0, [tree], [])
        values = [value + one.value(r) for r, value in zip(table, values)]
    for kind in range(len(KINDS)):
        own = sorted(((v, r) for v, r in zip(values, table) if r["kind"] == kind), key=lambda x: -x[0])
        right = wrong = 0
        for k, (value, r) in enumerate(own):
            right, wrong = right + r["positive"], wrong + r["negative"]
            last = k + 1 == len(own) or own[k + 1][0] < value
            if last and right and right / (right + wrong) >= PRECISION:
                found.thresholds[kind] = max(value - 1e-9, 0.0)
    return found


def train(df: DataFrame, text_col: str = "text") -> Trees:
    """Trees from all texts of ``df``; only the bounded table of cells reaches the driver."""
    texts = df.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return boost([row.asDict() for row in cells(texts).collect()])


def find(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` of every row: lists of ``start, kind, end``, in order.

    ``base`` has the valid base spans, which may overlap across kinds; ``spans`` has those and the selected others, which
    overlap neither a base span nor one another. A null text is an empty one. Null and repeated ids stay as they are,
    row by row; an empty table gives an empty one.
    """
    return _found(id_and_text(df, id_col, text_col), trees).select("doc_id", "base", "spans")


def _found(texts: DataFrame, trees: Trees) -> DataFrame:
    rows = _described(texts)
    limits = F.array(*(F.lit(float(t)) for t in trees.thresholds))

    def free(c: Column) -> Column:
        """No base span overlaps the candidate."""
        return (F.greatest(*(_last_end(c, kind) for kind in range(len(KINDS)))) <= c.start) & (c.next >= c.end)

    proposed = F.filter("candidates", lambda c: (c.generator > 0) & c.valid & free(c))
    scored = F.transform(proposed, lambda c: F.struct(
        c.start.alias("start"), c.end.alias("end"), c.kind.alias("kind"), (-trees.log_odds(_features(c))).alias("odds")))
    # in order of place; of equal spans the likeliest is the first
    chosen = F.array_sort(F.filter(scored, lambda c: -c.odds >= F.get(limits, c.kind)))
    rows = rows.withColumn("chosen", chosen)

    def fresh_span(c: Column, k: Column) -> Column:
        return (k == 0) | ~F.coalesce(_place(c) == _place(F.get("chosen", k - 1)), F.lit(False))

    rows = rows.withColumn("chosen", F.filter("chosen", fresh_span))
    ended = _before(F.transform("chosen", lambda c: c.end), F.lit(0), "int", lambda a, b: F.greatest(a, b))
    # joined as an argument, so that it is computed once and not in a function over the spans
    rows = rows.withColumn("chosen", F.zip_with("chosen", ended, lambda c, e: F.struct(*(c[n].alias(n) for n in ("start", "end", "kind", "odds")), e.alias("ended"))))

    def beats(d: Column, c: Column) -> Column:
        """Of two overlapping spans, the likelier, longer, earlier one, or the first kind stays."""
        order = lambda x: F.struct(x.odds, x.start - x.end, x.start, x.kind)
        return (d.start < c.end) & (c.start < d.end) & (order(d) < order(c))

    def stays(c: Column, k: Column) -> Column:
        alone = (c.ended <= c.start) & (F.coalesce(F.get("chosen", k + 1)["start"], c.end) >= c.end)
        first = F.greatest(k - NEAR, F.lit(0))
        return alone | ~F.exists(F.slice("chosen", first + 1, F.lit(2 * NEAR + 1)), lambda d: beats(d, c))

    added = F.transform(F.filter("chosen", stays), lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", added)))


def _place(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every span replaced by its kind in brackets."""
    found, text = _found(id_and_text(df, id_col, text_col), trees), F.col("text")
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s.start >= state.at, F.concat(F.substring(text, state.at + 1, F.greatest(s.start - state.at, F.lit(0))), F.get(names, s.kind))).otherwise("")
        return F.struct(F.greatest(state.at, s.end).alias("at"), F.concat(state.out, gap).alias("out"))

    done = F.aggregate("spans", start, step, lambda state: F.concat(state.out, F.substring(text, state.at + 1, F.length(text))))
    return found.select("doc_id", done.alias("text"))
