"""Secret scans (operator 8), in DataFrame functions only.

Base kinds are patterns. The method adds kind `entropy`: candidate strings are runs
of 20 or more token characters; each character class (hex, alphanumeric, base64) has
an alphabet, a window and a least Shannon entropy. A window slides over the candidate
with its count of each letter; a step changes the counts of the letter that leaves and
the one that comes, and with them n * H = n log n - sum c log c. A candidate whose best
window passes is a secret unless the allow list has it.

Positions are code points, end exclusive. A pattern's matches and the pieces between
them give all positions in one pass over the text. Work is in proportion to the length
of a candidate, and close to the number of matches (running sums are in blocks).

Defined cases: null text is empty: no spans; repeated rows are scanned alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates of the entropy scan, and what they need at least: a digit and a letter.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
NEEDS = (r"[0-9]", r"[A-Za-z]")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (class, pattern of the whole candidate, alphabet, window, least entropy in bits); the first class that fits counts.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", _DIGITS + "abcdefABCDEF", 20, 2.8),
    ("alnum", r"^[A-Za-z0-9]+$", _DIGITS + _LOWER + _UPPER, 20, 3.4),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", _DIGITS + _LOWER + _UPPER + "+/_=-", 20, 3.6),
)
#: Strings that look random but aren't secrets: ids with dashes in fixed places, one
#: character repeated, samples that say so; and paths and names of lower-case words (`pathlike`).
ALLOWED = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"(.)\1{7}", r"(?i)example|placeholder|xxxx")
#: Running sums are taken in blocks of so many, and their totals likewise.
BLOCK = 64


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, levels: int = 2) -> Column:
    """The running sums of an array. A fold that appends copies what it has, so folds are
    over blocks, and what comes before a block is a running sum of totals."""
    if not levels:
        return F.aggregate(
            numbers, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends")),
            lambda acc: acc["ends"],
        )

    def over(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        own = F.transform(starts, lambda i: running(F.slice(all_, i, F.lit(BLOCK)), 0))

        def shifted(blocks: Column) -> Column:
            totals = running(F.transform(blocks, lambda x: F.element_at(x, -1)), levels - 1)
            before = lambda sums, i: F.when(i == 0, 0).otherwise(F.get(sums, i - 1))
            return F.flatten(_let(totals, lambda sums: F.transform(blocks, lambda x, i: _let(before(sums, i), lambda b: F.transform(x, lambda e: e + b)))))

        return _let(own, shifted)

    return _let(numbers, over)


def located(hits: Column, text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of hits, the matches of pattern in text, in code
    points. The text is split again only where there are hits."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), F.length)
    sizes = F.zip_with(gaps, F.transform(hits, F.length), lambda g, n: g + n)
    ends = running(sizes)
    found = F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def _c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def best_entropy(s: Column, alphabet: str, window: int, enough: float = math.inf) -> Column:
    """The highest Shannon entropy (bits a character) of a window over s, by
    incremental counts; of s itself if it is shorter. Counts are a string with a
    character for each letter of the alphabet: code ZERO plus the letter's count. The
    window stops where one has `enough`."""
    zero = ord("0")
    letters = F.lit(alphabet)
    place = lambda c: F.instr(letters, c)
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - zero
    put = lambda counts, at, n: F.overlay(counts, F.char(n + zero), at, F.lit(1))
    empty = F.struct(F.lit("0" * len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"))

    def come(acc: Column, c: Column) -> Column:
        return _let(place(c), lambda at: _let(count(acc["counts"], at), lambda n: F.struct(put(acc["counts"], at, n + 1).alias("counts"), (acc["sum"] - _c_log_c(n) + _c_log_c(n + 1)).alias("sum"))))

    def gone(acc: Column, c: Column) -> Column:
        return _let(place(c), lambda at: _let(count(acc["counts"], at), lambda n: F.struct(put(acc["counts"], at, n - 1).alias("counts"), (acc["sum"] - _c_log_c(n) + _c_log_c(n - 1)).alias("sum"))))

    def over(chars: Column) -> Column:
        w = F.least(F.size(chars), F.lit(window))

        def slide(acc: Column, i: Column) -> Column:
            moved = lambda new: F.struct(new["counts"].alias("counts"), new["sum"].alias("sum"), F.least(acc["low"], new["sum"]).alias("low"))
            leaves, comes = F.get(chars, i - window), F.get(chars, i)
            return F.when((leaves == comes) | (F.log2(w) - acc["low"] / w >= enough), acc).otherwise(_let(come(gone(acc, leaves), comes), moved))

        first = F.aggregate(F.slice(chars, F.lit(1), w), empty, come)
        steps = F.when(F.size(chars) > window, F.sequence(F.lit(window), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))
        low = _let(first, lambda f: F.aggregate(steps, F.struct(f["counts"].alias("counts"), f["sum"].alias("sum"), f["sum"].alias("low")), slide, lambda acc: acc["low"]))
        return F.log2(w) - low / w

    return _let(F.filter(F.split(s, ""), lambda c: c != ""), over)


def pathlike(hit: Column) -> Column:
    """Lower-case words and short numbers with separators, a word first."""
    parts = F.split(hit, "[-_/=]", -1)
    return F.rlike(hit, F.lit("^[a-z]+[-_/=]")) & _let(parts, lambda p: F.forall(F.slice(p, F.lit(2), F.size(p)), lambda x: x.rlike("^[a-z0-9]{1,12}$")))


def suspicious(hit: Column) -> Column:
    """Whether a candidate has a window of high entropy and is on no allow list."""
    high = F.lit(False)
    for _, pattern, alphabet, window, least in reversed(CLASSES):
        high = F.when(hit.rlike(pattern), best_entropy(hit, alphabet, window, least) >= least).otherwise(high)
    high = F.when(pathlike(hit), F.lit(False)).otherwise(high)
    for allowed in ALLOWED:
        high = F.when(hit.rlike(allowed), F.lit(False)).otherwise(high)
    for needed in NEEDS:
        high = F.when(hit.rlike(needed), high).otherwise(F.lit(False))
    return high


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): found has start, kind (0 to 3, as in KINDS), end and hit of each secret."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    hits = src.select("doc_id", "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"h{k}") for k, p in enumerate(patterns)))
    at = hits.select("doc_id", *(located(F.col(f"h{k}"), F.col("text"), p).alias(f"k{k}") for k, p in enumerate(patterns)))
    kept = at.select(
        "doc_id", F.filter("k0", lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= ASSIGN_LEAST).alias("k0"),
        "k1", "k2", F.filter("k3", lambda m: suspicious(m["hit"])).alias("k3"),
    )
    return kept.select("doc_id", F.array_sort(F.concat(*(_tagged(k) for k in range(4)))).alias("found"))


def _tagged(kind: int) -> Column:
    return F.transform(f"k{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["hit"].alias("hit")))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"), m["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans."""
    n = lambda k: F.size(F.filter("found", lambda m: m["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda m: m["kind"] < 3)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )
