"""Language ID by cross-parsing entropy (operator 4).

Per language a suffix automaton of labelled text. A document is parsed against
each: the longest match from where the last phrase ended is the next phrase. The
language that needs the fewest phrases per letter wins; the score is the margin to
the runner-up, 1 - fewest / second fewest (1 if one language was learned).

Every letter of the sample is a symbol of its own; letters that no sample has match
nothing. Letters are lower-cased; every run of other characters is one separator.

Texts are parsed whole. To go through many at once, a text is cut in lanes of BLOCK
symbols that move in lockstep. Lanes start at the root; then each goes again from the
state in which the lane before it ended, until it meets its own first way, and so on
while any end moves. So the phrases are those of one pass over the whole text.

An automaton is shipped as three arrays (row displacement): some 0.7 MB a language.

The sample is bounded: per language at most SAMPLE_ROWS rows (the one with the
least hash of its id in each of SAMPLE_ROWS hash classes) and SAMPLE_CHARS symbols
in all. All other work covers all rows.

Defined cases: `und` with score 0 if text is null or has no letter, or nothing was
learned; ties go to the smaller name; rows with null id, text or language are not
learned from, a null doc_id is not held out; repeated rows are predicted alike;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 64
SAMPLE_CHARS = 24_000
BLOCK = 256
#: Lanes that move at once: bounds memory, whatever the size of a text.
LANES = 4096


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _normal_table() -> np.ndarray:
    """For each code point the lower-case letter, or 32 for anything else."""
    out = np.full(0x110000, 32, np.uint32)
    for x in range(0x110000):
        c = chr(x)
        if c.isalpha():
            low = c.lower()
            out[x] = ord(low[0]) if low[0].isalpha() else x
    return out


_tables: dict[str, np.ndarray] = {}


def normal_codes(text: str) -> np.ndarray:
    """Lower-case letters of text as code points, runs of anything else as one 32."""
    if "normal" not in _tables:
        _tables["normal"] = _normal_table()
    code = _tables["normal"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = code == 32
    return code[~(blank & np.concatenate([[True], blank[:-1]]))] if len(code) else code


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one sequence."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and s not in nxt[p]:
            nxt[p][s] = new
            p = link[p]
        if p != -1:
            q = nxt[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p != -1 and nxt[p].get(s) == q:
                    nxt[p][s] = copy
                    p = link[p]
        last = new
    return nxt


class Parser:
    """The automaton of one language as arrays. A state is its row's offset: the move by
    symbol c is next[state + c] if check[state + c] is state. Where there is none, the
    phrase ends and c starts the next one: root[c] (the root itself if c is unknown)."""

    def __init__(self, nxt: list[dict[int, int]], symbols: int) -> None:
        used, offsets, low = bytearray(symbols), {0: 0}, symbols  # the root's offset is 0, its row is root
        taken = {0}
        for state in sorted(range(1, len(nxt)), key=lambda i: (-len(nxt[i]), i)):
            moves = sorted(nxt[state])
            first = moves[0] if moves else 0
            while low < len(used) and used[low]:
                low += 1
            at, tries = low, 0
            while True:
                if len(used) < at + symbols + 1:
                    used.extend(bytes(at + symbols + 1 - len(used)))
                offset = at - first
                if offset not in taken and not any(used[offset + c] for c in moves):
                    break
                tries += 1
                at = at + 1 if tries < 64 else max(at + 1, len(used) - symbols - 1)
            taken.add(offset)
            offsets[state] = offset
            for c in moves:
                used[offset + c] = 1
        size = max(taken) + symbols + 1
        self.check, self.next, self.root = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(symbols + 1, np.int32)
        for c, to in nxt[0].items():
            self.root[c] = offsets[to]
        for state, moves in enumerate(nxt[1:], 1):
            for c, to in moves.items():
                self.check[offsets[state] + c], self.next[offsets[state] + c] = offsets[state], offsets[to]

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase starts."""
        at = state + c
        goes = self.check.take(at) == state
        return np.where(goes, self.next.take(at), self.root.take(c)), ~goes

    def phrases(self, columns: np.ndarray, sizes: np.ndarray, follows: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each lane, and its last state. columns: symbol t of each lane; sizes
        descend; follows: the lane before in the text, -1 if none, -2 if the lane starts in
        `state`."""
        n = columns.shape[1]
        states, starts = np.zeros(columns.shape, np.int32), np.zeros(columns.shape, bool)
        own = np.where(follows == -2, state, 0).astype(np.int32)
        count = np.zeros(n, np.int64)
        alive = np.searchsorted(-sizes, -np.arange(columns.shape[0]), "left")
        end = own.copy()
        for t in range(columns.shape[0]):
            m = alive[t]
            end[:m], starts[t, :m] = self.step(end[:m], columns[t, :m])
            states[t, :m] = end[:m]
            count[:m] += starts[t, :m]
        after = np.full(n, -1)
        after[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
        again = np.flatnonzero(follows >= 0)
        while len(again):
            lane, now, t, moved = again, end[follows[again]], 0, []
            while len(lane):
                over = sizes[lane] <= t
                if over.any():
                    moved.append(lane[over])
                    end[lane[over]] = now[over]
                    lane, now = lane[~over], now[~over]
                    continue
                now, new = self.step(now, columns[t, lane])
                count[lane] += new.astype(np.int64) - starts[t, lane]
                same = now == states[t, lane]
                starts[t, lane], states[t, lane] = new, now
                lane, now, t = lane[~same], now[~same], t + 1
            again = after[np.concatenate(moved)] if moved else np.empty(0, np.int64)
            again = again[again >= 0]
        return count, end


class Model:
    """languages, in order of name, the letters of the samples, and a parser for each."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        codes = {k: np.concatenate([np.empty(0, np.uint32), *(x for t in samples[k] for x in (normal_codes(t), np.array([32], np.uint32)))])[:SAMPLE_CHARS] for k in self.languages}
        #: symbol 0 is the separator, symbol i + 1 the letter i; one more is any other letter
        self.letters = np.unique(np.concatenate([np.empty(0, np.uint32), *codes.values()]))
        self.letters = self.letters[self.letters != 32]
        self.parsers = [Parser(suffix_automaton(self.to_symbols(codes[k]).tolist()), len(self.letters) + 1) for k in self.languages]

    def to_symbols(self, codes: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_map"):
            self._map = np.full(0x110000, len(self.letters) + 1, np.int32)
            self._map[32] = 0
            self._map[self.letters] = np.arange(1, 1 + len(self.letters))
        return self._map[codes]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_map"}

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (its symbols, not empty) for each language."""
        sizes = np.array([len(x) for x in parts])
        per = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(parts)), per)
        place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        out = np.zeros((len(parts), len(self.parsers)), np.int64)
        state = [0] * len(self.parsers)
        for low in range(0, len(text), LANES):
            of, at = text[low : low + LANES], place[low : low + LANES]
            lane = np.zeros((len(of), BLOCK), np.int32)
            for i, (x, j) in enumerate(zip(of.tolist(), at.tolist())):
                cut = parts[x][j * BLOCK : (j + 1) * BLOCK]
                lane[i, : len(cut)] = cut
            size = np.minimum(BLOCK, sizes[of] - at * BLOCK)
            # longest lanes first
            order = np.argsort(-size, kind="stable")
            where = np.empty(len(order), np.int64)
            where[order] = np.arange(len(order))
            follows = np.where(at > 0, np.arange(len(of)) - 1, -1)
            first = follows == -1
            follows = np.where(first, -1, where[follows])
            if at[0] > 0:
                follows[0] = -2
            columns = np.ascontiguousarray(lane[order].T[: int(size.max())])
            for k, parser in enumerate(self.parsers):
                count, ends = parser.phrases(columns, size[order], follows[order], state[k])
                out[:, k] += np.bincount(of, weights=count[where], minlength=len(parts)).astype(np.int64)
                state[k] = int(ends[where[-1]])
        return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, score, and the fewest phrases per letter, of each text."""
    rows, letters, parts = [], [], []
    for i, text in enumerate(texts):
        s = model.to_symbols(normal_codes(text or ""))
        n = int(np.count_nonzero(s))
        if n and model.languages:
            rows.append(i)
            letters.append(n)
            parts.append(s)
    names, scores, rates = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not rows:
        return names, scores, rates
    rate = model.phrases(parts) / np.array(letters)[:, None]
    best = rate.argmin(1)
    for i, r, b in zip(rows, rate, best):
        second = np.delete(r, b).min(initial=np.inf)
        names[i], rates[i] = model.languages[b], float(r[b])
        scores[i] = float(1 - r[b] / second)
    return names, scores, rates


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from docs, of a bounded sample of rows that are not held out."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.xxhash64("doc_id")
    picked = own.groupBy("lang", F.pmod(h, F.lit(SAMPLE_ROWS)).alias("k")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("m")).select("m.doc_id").collect()
    samples: dict[str, dict] = {}
    for r in own.where(F.col("doc_id").isin([r.doc_id for r in picked])).select("lang", h.alias("h"), "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).distinct().collect() if picked else []:
        samples.setdefault(r.lang, []).append((r.h, r.doc_id, r.text))
    chosen = {}
    for lang, found in samples.items():
        found.sort()
        held, texts = 0, []
        for _, _, text in found:
            if held < SAMPLE_CHARS:
                texts.append(text)
                held += len(text)
        chosen[lang] = texts
    return Model(chosen)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rate) of each row; rate: phrases per letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores, rates = predict(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], ["doc_id", "lang_pred", "score", "rate"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(scan, "doc_id long, lang_pred string, score double, rate double")


def filter_known(docs: DataFrame, model: Model, max_rate: float, text_col: str = "text") -> DataFrame:
    """docs (all columns) without texts of no language (`und`) and texts that need
    over max_rate phrases per letter in every learned language. If no language was
    learned, only texts without a letter go."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = part.column(at).to_pylist()
                if shared.value.languages:
                    names, _, rates = predict(shared.value, texts)
                    keep = [n != "und" and r <= max_rate for n, r in zip(names, rates)]
                else:
                    keep = [bool((normal_codes(x or "") != 32).any()) for x in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
