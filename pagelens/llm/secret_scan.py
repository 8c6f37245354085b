"""Secret scans: fixed patterns and a battery of randomness tests (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, stored, unused

#: Fixed patterns: kind, expression, and the group and least length that a match needs. Order breaks ties of start.
KINDS = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
#: What the battery looks at: runs of these characters, and their least length.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: The same matches: one starts where a run of these characters does, so places inside a run needn't be tried.
TOKEN_RUN = r"(?<![A-Za-z0-9+/_-])" + TOKEN
#: Encodings by the characters a token keeps to: name, expression, alphabet in order of value, and if case is folded.
#: The first that fits is taken.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("decimal", r"^[0-9]+$", DIGITS, False),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", True),
    ("letters", r"^(?:[a-z]+|[A-Z]+)$", LOWER, True),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", False),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER, True),
    ("letters of both cases", r"^[A-Za-z]+$", UPPER + LOWER, False),
    ("base62", r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS, False),
    ("base64", r"^[0-9A-Za-z+/_-]+=*$", UPPER + LOWER + DIGITS + "+/", False),
]
#: False discoveries allowed among the distinct tokens that are reported, in each class of length.
FDR = 0.05
#: Classes of length, by lower bound; p-values are counted in tenths of their decimal logarithm, down to 10**-30.
LENGTHS = (20, 24, 32, 40, 64, 128)
STEPS_10, MAX_STEP = 10, 300
NO_MATCH = "cast(array() as array<struct<start:bigint,end:bigint,token:string>>)"
NO_TOKEN = "cast(array() as array<struct<start:bigint,end:bigint,class:int,step:int,hash:bigint>>)"
MARK = "[SECRET]"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches, none overlapping, as code-point spans ``array<struct<start,end,token>>``.

    The pieces between matches have the lengths that the matches' places lack. Matches whose ``group`` is shorter than
    ``least`` are dropped after matching, so they still use up their characters. Lengths are summed in blocks of about
    the root of the number of matches, as an array that grows one by one is copied each time.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.filter(F.arrays_zip(F.split(text, pattern).alias("piece"), whole.alias("whole"), part.alias("part")), lambda r: r["whole"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["whole"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("token")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def block(some: Column) -> Column:
        return F.aggregate(some, F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(NO_MATCH).alias("found")), step)

    def blocks(r: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(r)))).cast("int")
        last = F.greatest(F.lit(0), F.ceil(F.size(r) / size).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: block(F.slice(r, i * size + 1, size)))

    def placed(parts: Column) -> Column:
        state = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<bigint>)").alias("starts"))
        starts = F.aggregate(parts, state, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        return F.flatten(F.zip_with(parts, starts, lambda x, s: F.transform(x["found"], lambda m: F.struct((m["start"] + s).alias("start"), (m["end"] + s).alias("end"), m["token"].alias("token")))))

    return F.when(text.rlike(pattern), _let(_let(rows, blocks), placed)).otherwise(F.expr(NO_MATCH))


def upper_normal(z: Column) -> Column:
    """P(Z > z) of the normal distribution by a logistic approximation, near enough for a threshold."""
    return _let(z, lambda z: 1 / (1 + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), 0.07056 * z * z * z + 1.5976 * z)))))


def _total(array: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + f(x))


#: Letters are written as characters around this code: those of the upper half of an alphabet from it on. A character's
#: code less this is the letter's place, counted from the alphabet's middle.
MIDDLE = 80
HALVES = "".join(map(chr, range(MIDDLE - 32, MIDDLE + 32))), "0" * 32 + "1" * 32
#: Least p-value that has a step of its own.
P_MIN = 1e-30


def evenness(coded: Column, k: Column) -> Column:
    """p-value of a text being drawn evenly from k letters: the least of three tests' p, times three.

    Chi-squared of the alphabet's counts (Wilson-Hilferty), number of runs above and below the alphabet's middle
    (Wald-Wolfowitz), and correlation of neighbours. ``coded`` is the text with its letters written as around MIDDLE.
    Counts come from the stretches of the sorted text, so the work follows a text's length, whatever the alphabet. Where
    the counts alone give P_MIN or less, that is the result and the other tests, which could only lower it, aren't made.
    """
    size = F.length(coded)
    n, dof = size.cast("double"), k - 1
    lost = lambda s, part: (F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))).cast("double")
    place = lambda c: (F.ascii(c) - MIDDLE).cast("bigint")

    def p_chi(same: Column) -> Column:
        squares = _total(same, lambda s: F.length(s).cast("bigint") * F.length(s)).cast("double")
        return upper_normal((F.pow(F.greatest(squares * k / n - n, F.lit(0.0)) / dof, F.lit(1 / 3)) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof)))

    def p_runs(halves: Column) -> Column:
        changes = (lost(halves, "01") + lost(halves, "10")) / 2

        def tail(mean: Column) -> Column:
            return 2 * upper_normal(F.abs(changes + 1 - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))))

        return _let(_let(lost(halves, "1"), lambda high: 2 * high * (n - high) / n + 1), tail)

    def p_serial(sums: Column) -> Column:
        first, last, neighbours = sums["first"], sums["last"], sums["neighbours"]
        centre = sums["sum"] / n
        power = F.greatest(sums["squares"] - centre * sums["sum"], F.lit(1e-9))
        together = neighbours - centre * (2 * sums["sum"] - first - last) + (n - 1) * centre * centre
        return 2 * upper_normal(F.abs(together / power + 1 / n) * F.sqrt(n))

    def sums(values: Column) -> Column:
        beside = F.zip_with(F.slice(values, F.lit(1), size - 1), F.slice(values, F.lit(2), size - 1), lambda a, b: a * b)
        parts = {"sum": _total(values, lambda v: v), "squares": _total(values, lambda v: v * v), "neighbours": _total(beside, lambda v: v), "first": F.get(values, F.lit(0)), "last": F.element_at(values, -1)}
        return F.struct(*[c.cast("double").alias(name) for name, c in parts.items()])

    def least(letters: Column) -> Column:
        same = F.regexp_extract_all(F.array_join(F.sort_array(letters), ""), F.lit(r"(.)\1*"), F.lit(0))
        runs = lambda: _let(F.translate(coded, *HALVES), p_runs)
        serial = lambda: _let(_let(F.transform(letters, place), sums), p_serial)
        return _let(_let(same, p_chi), lambda chi: F.when(3 * chi <= P_MIN, P_MIN).otherwise(F.least(F.lit(1.0), 3 * F.least(chi, runs(), serial()))))

    return _let(F.split(coded, ""), least)


def p_step(token: Column) -> Column:
    """Step of the battery's p-value in the encoding that the token keeps to; 0 for one as even as can be."""

    def written(clean: Column) -> Column:
        def one(letters: str, fold: bool) -> Column:
            k = len(letters)
            codes = "".join(chr(MIDDLE + i - (k + 1) // 2) for i in range(k))
            return F.struct(F.translate(F.lower(clean) if fold else clean, letters, codes).alias("coded"), F.lit(float(k)).alias("k"))

        x = one(*ENCODINGS[-1][2:])
        for _, pattern, letters, fold in reversed(ENCODINGS[:-1]):
            x = F.when(token.rlike(pattern), one(letters, fold)).otherwise(x)
        return x

    def measure(c: Column) -> Column:
        return F.least(F.lit(MAX_STEP), F.floor(-STEPS_10 * F.log10(F.greatest(evenness(c["coded"], c["k"]), F.lit(P_MIN))))).cast("int")

    bare = F.when(F.endswith(token, F.lit("=")), F.regexp_replace(token, "=+$", "")).otherwise(token)
    return _let(_let(F.when(token.rlike("[-_]"), F.translate(bare, "-_", "+/")).otherwise(bare), written), measure)


def tokens(text: Column) -> Column:
    """Tokens that the battery looks at: span, class of length, step of p-value, and a hash that tells tokens apart."""

    def judge(m: Column) -> Column:
        kind = reduce(lambda c, i: F.when(m["end"] - m["start"] >= LENGTHS[i], i).otherwise(c), range(1, len(LENGTHS)), F.lit(0))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), kind.alias("class"), p_step(m["token"]).alias("step"), F.xxhash64(m["token"]).alias("hash"))

    return F.when(text.rlike(TOKEN_RUN), F.transform(matches(text, TOKEN_RUN), judge)).otherwise(F.expr(NO_TOKEN))


def ordinary(text: Column) -> Column:
    """One string of ordinary text run together, of a class' least length, if there is as much: a quick null hypothesis.

    Thresholds that rest on it come from a sample of the text; all_ordinary() takes all of it, as the queries do. A hash of the text chooses the class and the place where it starts; tokens themselves and all but letters and
    digits are left out.
    """
    longest = LENGTHS[-1]
    kind = F.pmod(F.xxhash64(text, F.lit(1)), F.lit(len(LENGTHS))).cast("int")
    at = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - 2 * longest + 1)).cast("int") + 1
    plain = F.regexp_replace(F.regexp_replace(F.substring(text, at, F.lit(2 * longest)), TOKEN, ""), "[^A-Za-z0-9]+", "")
    chosen = F.struct(kind.alias("class"), F.substring(plain, F.lit(1), F.array(*[F.lit(n) for n in LENGTHS])[kind]).alias("s"))

    def of(c: Column) -> Column:
        whole = F.length(c["s"]) >= F.array(*[F.lit(n) for n in LENGTHS])[c["class"]]
        return F.when(whole, F.array(F.struct(c["class"].alias("class"), p_step(c["s"]).alias("step"), F.xxhash64(c["s"]).alias("hash"))))

    return _let(chosen, of)


def all_ordinary(text: Column) -> Column:
    """Ordinary text run together, all of it, which tokens are held against: strings of the classes' least lengths.

    Tokens and all but letters and digits are left out. What is left is cut from its start into a string of each class
    in turn, over and over; the rest that is too short for all of them, into the longest that fit. Fewer characters than
    the shortest class has may remain. So each character stands in one string, and each class gets strings of all texts.
    """
    whole = sum(LENGTHS)
    tail = "|".join(f".{{{n}}}" for n in reversed(LENGTHS))

    def cut(plain: Column) -> Column:
        turn = lambda s: F.array(*[F.substring(s, sum(LENGTHS[:i]) + 1, n) for i, n in enumerate(LENGTHS)])
        turns = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(f".{{{whole}}}"), F.lit(0)), turn))
        rest = F.substring(plain, F.length(plain) - F.length(plain) % whole + 1, F.lit(whole))
        return F.concat(turns, F.regexp_extract_all(rest, F.lit(tail), F.lit(0)))

    def judge(s: Column) -> Column:
        kind = F.array_position(F.array(*[F.lit(n) for n in LENGTHS]), F.length(s)).cast("int") - 1
        return F.struct(kind.alias("class"), p_step(s).alias("step"), F.xxhash64(s).alias("hash"))

    plain = F.regexp_replace(F.regexp_replace(text, TOKEN_RUN, ""), "[^A-Za-z0-9]+", "")
    return F.transform(_let(plain, cut), judge)


def random_steps(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each class of length the largest step of tokens that are said to be random (Benjamini-Hochberg).

    ``found`` has columns tokens() and ordinary, strings by all_ordinary() or ordinary(). The null hypothesis is that a token is ordinary text run together:
    its p-value is the share of the corpus' own ordinary strings, no longer than the token's class, that look as even
    or more, (1 + those) / (1 + all). The largest step whose p-value is at most ``fdr`` times the share of distinct
    tokens up to it is the limit, so of the tokens reported about ``fdr`` at most are ordinary. Copies of tokens and of
    ordinary strings count once. A class without a limit has none reported. Only counts by class and step leave the
    cluster.
    """

    def steps(column: str, name: str) -> DataFrame:
        each = found.select(F.explode(column).alias("t")).select("t.class", "t.step", "t.hash").distinct()
        return each.groupBy("class", "step").agg(F.count(F.lit(1)).alias(name))

    both = steps("tokens", "n").join(steps("ordinary", "d"), ["class", "step"], "full_outer").na.fill(0)  # a row a class and step
    up, all_ = W.partitionBy("class").orderBy("step"), W.partitionBy("class")
    seen = both.select("class", "step", F.sum("n").over(up).alias("n"), F.sum("d").over(up).alias("d"), F.sum("n").over(all_).alias("all_n"), F.sum("d").over(all_).alias("all_d"))
    limit = seen.where((F.col("n") > 0) & ((1 + F.col("d")) / (1 + F.col("all_d")) <= fdr * F.col("n") / F.col("all_n"))).groupBy("class").agg(F.max("step").alias("step"))
    return {r["class"]: r["step"] for r in limit.collect()}  # a row for each class of LENGTHS


def random_spans(found: Column, limits: dict[int, int]) -> Column:
    """Of tokens(), those as even as their class' limit asks."""
    limit = lambda t: reduce(lambda c, item: F.when(t["class"] == item[0], item[1]).otherwise(c), sorted(limits.items()), F.lit(-1))
    return F.transform(F.filter(found, lambda t: t["step"] <= limit(t)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))


def base_spans(text: Column) -> list[Column]:
    """Spans of each fixed pattern, in the order of KINDS."""
    return [F.transform(matches(text, pattern, group, least), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for _, pattern, group, least in KINDS]


def _joined(parts: list[tuple[str, Column]]) -> Column:
    """All spans by start, then in the order of ``parts``: ``array<struct<start,rank,kind,end>>``."""

    def named(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*[named(i, kind, spans) for i, (kind, spans) in enumerate(parts)]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _found(text: Column, null: Callable[[Column], Column]) -> Column:
    """All that a text gives, as one struct: spans of the fixed patterns, tokens() and, by ``null``, ordinary strings."""
    return F.struct(*[c.alias(f"base_{kind}") for c, (kind, *_) in zip(base_spans(text), KINDS)], tokens(text).alias("tokens"), null(text).alias("ordinary"))


def scan_secrets(docs: DataFrame, fdr: float = FDR, null: Callable[[Column], Column] = ordinary) -> DataFrame:
    """``(doc_id, base, spans)`` for every row of ``docs(doc_id, text)``; arrays of ``struct<start,rank,kind,end>``.

    ``base`` has the matches of KINDS, ``spans`` these and, as kind ``random``, the tokens that the battery finds too
    even for ordinary text, at a false-discovery rate of ``fdr`` among those reported in each class of length, see
    random_steps(). Spans are in code points, end exclusive. ``null`` gives the ordinary strings of a text:
    all_ordinary() all of them, ordinary() one.

    Null text counts as empty and has no spans. Repeated rows repeat; an empty table gives no rows; further columns
    are ignored. In a table without ordinary text to compare with, or with too little of it, no span is ``random``.
    Nothing but spans and steps is kept between the two passes.
    """
    found = materialize(docs.select("doc_id", _found(F.coalesce("text", F.lit("")), null).alias("f")).select("doc_id", "f.*"))
    kinds = [(kind, F.col(f"base_{kind}")) for kind, *_ in KINDS]
    extra = ("random", random_spans(F.col("tokens"), random_steps(found, fdr)))
    return found.select("doc_id", _joined(kinds).alias("base"), _joined([*kinds, extra]).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text, from scan_secrets()."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, fdr: float = FDR, mark: str = MARK, null: Callable[[Column], Column] = ordinary) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (overlapping ones by one); all else is unchanged.

    Null texts stay null. What each text gives is found once and kept beside it, in the shared folder, until the
    limits of the battery are known from all of ``docs``.
    """
    own = unused(docs, "found")
    held = stored(docs.withColumn(own, _found(F.coalesce("text", F.lit("")), null)))
    limits = random_steps(held.select(f"{own}.tokens", f"{own}.ordinary"), fdr)
    text, found = F.col("text"), F.col(own)
    spans = _joined([*[(kind, found[f"base_{kind}"]) for kind, *_ in KINDS], ("random", random_spans(found["tokens"], limits))])
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("gaps"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    def cut(acc: Column) -> Column:
        gaps = F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("start"), F.length(text).cast("bigint").alias("end"))))
        return F.array_join(F.transform(gaps, lambda g: F.substring(text, (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int"))), mark)

    clean = _let(spans, lambda x: F.when(F.size(x) > 0, F.aggregate(x, state, step, cut)).otherwise(text))
    return held.withColumn("text", clean).drop(own)
