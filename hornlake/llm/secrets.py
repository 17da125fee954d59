"""Operator 3: secrets in whole texts, with code-point spans.  DataFrame functions only, and no shuffle.

Base kinds are patterns, matched leftmost and without overlap.  The entropy kind looks at candidate strings, the long
runs of token characters outside base spans: a window slides over each, its character counts change by one character
in and one out, and the greatest Shannon entropy decides against the threshold of the candidate's character class.
Known harmless forms are on an allow-list.  All steps take time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

#: The base patterns, which spans follow them in this order, and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Candidates: runs of token characters of at least SHORT, with letters and digits mixed; windows of WINDOW characters, or
#: the whole candidate where it is shorter.
SHORT, WINDOW = 16, 24
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least entropy of some window as a share of the most that its length allows, by class: hexadecimal digits, one letter
#: case with digits, both cases with digits, and candidates shorter than WINDOW, which must have both cases.
LEAST_HEX, LEAST_ONE_CASE, LEAST_TWO_CASES, LEAST_SHORT = 0.70, 0.83, 0.87, 0.92

#: Allow-list for whole candidates: UUIDs, paths and slugs of plain words.  Possessive, so no match backtracks or recurses.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[/_=+-]*+(?:[A-Za-z]++|[0-9]{1,4}+)(?:[/_=+-]++(?:[A-Za-z]++|[0-9]{1,4}+))*+[/_=+-]*+$",
]
#: Allow-list for the window that decides: runs of one character, alphabets and counting, example markers.
ALLOWED_WINDOW = [
    r"(.)\1{7,}",
    r"(?i)abcdefgh|01234567|12345678|qwerty|example|sample|placeholder|changeme|dummy|xxxx",
]

#: Counts of a window's symbols are packed, PACK counts of 5 bits in a long.
PACK = 12
_TERMS = [0.0] + [k * log2(k) for k in range(1, WINDOW + 2)]
#: Items of a block of a scan: an append copies a block, and every block's result once for each later block.
SCAN = 128
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, kind: str, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The array of what step(state, item) -> (state, out) gives for each item in order; `kind` is the type of out."""
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, x: Column) -> Column:
        at, out = step(s["at"], x)
        return F.struct(at.alias("at"), F.concat(s["out"], F.array(out)).alias("out"))

    def block(s: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(s["at"].alias("at"), none.alias("out")), one)
        return bind(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))

    def over(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / SCAN).cast("int") - 1), lambda b: F.slice(items, b * SCAN + 1, F.lit(SCAN)))
        whole = F.aggregate(blocks, F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda s: F.flatten(s["out"]))
        return F.when(F.size(items) > 0, whole).otherwise(none)

    return bind(items, over)


def _spans(kind: str, order: int, text: Column, pattern: str, keep) -> Column:
    """Spans [start, end) in code points of the matches, leftmost without overlap, that `keep` accepts."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return end, F.when(keep(x["hit"]), span)

    def of(hits: Column) -> Column:
        return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))

    pairs = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)
    return F.filter(scan(pairs, _SPAN, F.lit(0).cast("bigint"), step), lambda s: s.isNotNull())


def best_window(word: Column, window: Column) -> Column:
    """at, sum: the window of greatest Shannon entropy of an ASCII string, by its first place and its sum of k log2 k.

    State: packed counts of the window's symbols and the sum of k log2 k over them.  A step changes two counts.  The
    entropy is log2(window) - sum / window, so the least sum is the greatest entropy.
    """
    term = F.array(*[F.lit(x) for x in _TERMS])
    places = -(-(len(_SYMBOLS) + 1) // PACK)

    def bump(state: Column, symbol: Column, by: int) -> Column:
        shift = F.pmod(symbol, F.lit(PACK)) * 5
        cell, unit = F.floor(symbol / PACK).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
        k = F.call_function("shiftright", F.get(state["counts"], cell), shift).bitwiseAND(F.lit(31)).cast("int")
        counts = F.transform(state["counts"], lambda c, i: F.when(i == cell, c + by * unit).otherwise(c))
        return F.struct(counts.alias("counts"), (state["sum"] - F.get(term, k) + F.get(term, k + by)).alias("sum"), state["best"].alias("best"), state["best_at"].alias("best_at"))

    def over(symbols: Column) -> Column:
        steps = F.transform(symbols, lambda c, i: F.struct(c.alias("into"), F.when(i >= window, F.get(symbols, i - window)).alias("out"), (i - window + 1).alias("at")))

        def step(state: Column, x: Column) -> Column:
            def slid(s: Column) -> Column:
                better = (x["at"] >= 0) & (s["sum"] < s["best"] - 1e-9)
                return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), F.when(better, s["sum"]).otherwise(s["best"]).alias("best"), F.when(better, x["at"]).otherwise(s["best_at"]).alias("best_at"))

            grown = bump(state, x["into"], 1)
            return bind(F.when(x["out"].isNull(), grown).otherwise(bind(grown, lambda g: bump(g, F.coalesce(x["out"], F.lit(0)), -1))), slid)

        empty = F.struct(F.array_repeat(F.lit(0).cast("bigint"), places).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("best"), F.lit(0).alias("best_at"))
        return F.aggregate(steps, empty, step, lambda s: F.struct(s["best_at"].alias("at"), s["best"].alias("sum")))

    return bind(F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.instr(F.lit(_SYMBOLS), c)), over)


def _is_secret(word: Column) -> Column:
    digits, lower, upper = word.rlike("[0-9]"), word.rlike("[a-z]"), word.rlike("[A-Z]")
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    length = F.char_length(word)
    window = F.least(length, F.lit(WINDOW))
    share = F.when(length < WINDOW, F.lit(LEAST_SHORT)).when(word.rlike("^[0-9a-fA-F]+$"), F.lit(LEAST_HEX)).when(lower & upper, F.lit(LEAST_TWO_CASES)).otherwise(F.lit(LEAST_ONE_CASE))

    def decided(best: Column) -> Column:
        own, marked = F.substring(word, best["at"] + 1, window), F.lit(False)
        for pattern in ALLOWED_WINDOW:
            marked = marked | own.rlike(pattern)
        return (F.log2(window.cast("double")) - best["sum"] / window >= share * F.log2(window.cast("double"))) & ~marked

    mixed = digits & (lower | upper) & ((length >= WINDOW) | lower & upper)
    return F.when(mixed & ~allowed, bind(best_window(word, window), decided)).otherwise(F.lit(False))


def _apart(spans: Column) -> Column:
    """Sorted spans without the entropy spans that meet a base span: one scan looks back, one ahead."""
    base = lambda x: x["rank"] < 3
    back = lambda at, x: (F.when(base(x), F.greatest(at, x["end"])).otherwise(at), F.when(base(x) | (x["start"] >= at), x))
    ahead = lambda at, x: (F.when(base(x), x["start"]).otherwise(at), F.when(base(x) | (x["end"] <= at), x))
    there = lambda found: F.filter(found, lambda s: s.isNotNull())
    first = there(scan(spans, _SPAN, F.lit(0).cast("bigint"), back))
    return F.reverse(there(scan(F.reverse(first), _SPAN, F.lit(2**62), ahead)))


def find_spans(text: Column) -> Column:
    """Sorted spans of all kinds in `text`; entropy spans that meet a base span are left out."""
    empty = F.array().cast(f"array<{_SPAN}>")

    def found(kind: str, order: int, pattern: str, there: Column, keep) -> Column:
        return F.when(there & text.rlike(pattern), _spans(kind, order, text, pattern, keep)).otherwise(empty)

    anything = F.lit(True)
    some = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    value = lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST
    every = F.concat(
        found("assign", 0, ASSIGN, some, value),
        found("access", 1, ACCESS, F.contains(text, F.lit("AKIA")), lambda hit: anything),
        found("hex", 2, HEX, anything, lambda hit: anything),
        found("entropy", 3, CANDIDATE, anything, _is_secret),
    )
    return bind(every, lambda a: F.when(F.size(a) > 1, _apart(F.array_sort(a))).otherwise(a))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    Null and empty texts have no spans (the digest of the empty string).  Texts and runs of any length are read whole, in
    time that grows as they do.  Spans that begin together come in the order of their kinds.  Null ids stay null; repeated
    rows repeat; an empty table gives no rows; other columns are not read, so their names may clash with ours.
    """
    rows = docs.select("doc_id", find_spans(text_of()).alias("all"))
    base = F.filter("all", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("all", lambda s: s["rank"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))


def mask_documents(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """All rows and columns of `docs`, each span in the text replaced by `mark`; overlapping spans become one mark.

    Null texts stay null, texts without spans as they are; texts of any length are read whole; repeated rows repeat; an
    empty table stays empty; other columns may have any names.
    """
    spans, text = fresh(docs, "__spans"), F.col("text")
    gap = "struct<a:bigint,n:bigint>"
    step = lambda at, s: (F.greatest(at, s["end"]), F.when(s["start"] >= at, F.struct(at.alias("a"), (s["start"] - at).alias("n"))))
    gaps = F.filter(scan(F.col(spans), gap, F.lit(0).cast("bigint"), step), lambda g: g.isNotNull())
    last = F.array_max(F.transform(F.col(spans), lambda s: s["end"]))

    def pieces(characters: Column) -> Column:
        part = lambda a, n: F.array_join(F.slice(characters, (a + 1).cast("int"), n.cast("int")), "")
        before = F.transform(gaps, lambda g: F.concat(part(g["a"], g["n"]), F.lit(mark)))
        return F.concat(F.array_join(before, ""), part(last, F.size(characters) - last))

    characters = F.filter(F.split(text, ""), lambda c: c != "")
    masked = F.when(F.size(spans) > 0, bind(characters, pieces)).otherwise(text)
    return docs.withColumn(spans, find_spans(text_of())).withColumn("text", masked).drop(spans)
