"""Word alignment of candidate pairs, as Arrow-batched functions over columns of word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SAME, VARIANT, NEAR, OTHER, GAP = 2.0, 1.0, 0.5, -1.0, -1.0
#: Cells of the tables of several pairs that are aligned together.
CELLS = 1 << 19
ALIGNMENT = "similarity double, coverage double, same int, variant int, near int, changed int, extra int, missing int, first int, last int, ops array<struct<op:string,spoken:string,source:string>>"


def edit_distance(a: str, b: str) -> int:
    """Edits between two words; those of common length are compared without arrays, whose calls would take longer than the letters."""
    if len(a) * len(b) <= 1024:
        above = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            here = [i]
            for j, d in enumerate(b, 1):
                here.append(min(above[j] + 1, here[-1] + 1, above[j - 1] + (c != d)))
            above = here
        return above[-1]
    row = np.arange(len(b) + 1)
    right = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, c in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (right != ord(c)))
        best = np.concatenate(([i], best))
        row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return int(row[-1])


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between the words of each pair; pairs of like lengths are compared together."""
    sizes = np.array([[len(x) for x in side] for side in (a, b)], np.int64).reshape(2, -1)
    out, order = np.zeros(len(a), np.int64), np.lexsort((sizes[1], sizes[0]))
    letters = [np.frombuffer("".join(side[k] for k in order).encode("utf-32-le", "surrogatepass"), np.uint32) for side in (a, b)]
    starts = [np.cumsum(size[order]) - size[order] for size in sizes]
    at = 0
    while at < len(order):
        end = at + max(1, CELLS // ((int(sizes[0][order[at]]) + 1) * (int(sizes[1][order[at:]].max()) + 1)))
        end = at + max(1, int(np.searchsorted(sizes[0][order[at:end]], sizes[0][order[at]], "right")))  # of one length on the left
        these = order[at:end]
        n, lengths = int(sizes[0][these[0]]), sizes[1][these]
        m = int(lengths.max())
        x, y = (np.where(np.arange(k) < size[these][:, None], np.append(own, 0)[np.minimum(start[at:end, None] + np.arange(k), len(own))], 0) for k, size, own, start in zip((n, m), sizes, letters, starts))
        above, places = np.broadcast_to(np.arange(m + 1, dtype=np.int32), (len(these), m + 1)), np.arange(m + 1, dtype=np.int32)
        for i in range(n):
            here = np.empty_like(above)
            here[:, 0] = i + 1
            np.minimum(above[:, 1:] + 1, above[:, :-1] + (x[:, i, None] != y), out=here[:, 1:])
            here -= places
            np.minimum.accumulate(here, axis=1, out=here)
            here += places
            above = here
        out[these], at = above[np.arange(len(these)), lengths], end
    return out


def _bare(w: str) -> str:
    return w[:1] + w[1:].replace("ا", "")


class Relations:
    """Scores of word pairs: same skeleton, same stem, a small edit away, or other."""

    def __init__(self, stem=None):
        self.stem, self.known, self.words = stem or (lambda w: w), {}, {}

    def __call__(self, a: str, b: str) -> float:
        if a == b:
            return SAME
        if (a, b) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[a, b] = self._relation(a, b)
        return self.known[a, b]

    def _facts(self, word: str) -> tuple[int, int, str, str]:
        """Length, letters as bits, bare form and stem of a word."""
        if word not in self.words:
            if len(self.words) > 200_000:
                self.words.clear()
            bits = 0
            for c in set(word):
                bits |= 1 << (ord(c) & 63)
            self.words[word] = len(word), bits, _bare(word), self.stem(word)
        return self.words[word]

    def prepared(self, names: list[str]) -> tuple:
        """Source words laid out for `scores`: lengths and letters as arrays, places by bare form and by stem."""
        facts = [self._facts(w) for w in names]
        bare: dict[str, list[int]] = {}
        stems: dict[str, list[int]] = {}
        for k, (_, _, b, s) in enumerate(facts):
            bare.setdefault(b, []).append(k)
            stems.setdefault(s, []).append(k)
        return names, np.array([f[0] for f in facts], np.int64), np.array([f[1] for f in facts], np.uint64), bare, stems

    def scores(self, word: str, prepared: tuple) -> np.ndarray:
        """The relation of one word to every prepared one. Only words that length and letters leave in question are compared letter by letter."""
        names, lengths, letters, bare, stems = prepared
        n, bits, own_bare, own_stem = self._facts(word)
        most, out = np.maximum(lengths, n), np.full(len(names), OTHER, np.float32)
        own = np.uint64(bits)
        apart = np.maximum(np.bitwise_count(letters & ~own), np.bitwise_count(own & ~letters)).astype(np.int64)
        for k in np.flatnonzero((most >= 4) & (4 * np.maximum(apart, np.abs(lengths - n)) <= most)):
            out[k] = self(word, names[k])
        if len(own_stem) >= 2:
            out[stems.get(own_stem, [])] = VARIANT
        out[bare.get(own_bare, [])] = SAME
        return out

    def _relation(self, a: str, b: str) -> float:
        if _bare(a) == _bare(b):
            return SAME
        s, t = self.stem(a), self.stem(b)
        if s == t and len(s) >= 2:
            return VARIANT
        most = max(len(a), len(b))
        # each letter that only one of the words has is an edit
        letters, others = set(a), set(b)
        if most >= 4 and max(abs(len(a) - len(b)), len(letters - others), len(others - letters)) <= most / 4 and 1 - edit_distance(a, b) / most >= 0.75:
            return NEAR
        return OTHER


def local_alignment(spoken: list[str], source: list[str], relation) -> dict:
    """Best local alignment of `spoken` inside `source`, with its score and the spoken words up to its `end`.

    Of equal moves a match goes before a gap in the source, of equal cells the first. The table has a cell for each
    pair of words: a long source is given in windows (`best_alignment`).
    """
    n, m = len(spoken), len(source)
    if not n or not m:
        return {"similarity": 0.0, "coverage": 0.0, "same": 0, "variant": 0, "near": 0, "changed": 0, "extra": n, "missing": 0, "first": -1, "last": -1, "ops": [("extra", w, None) for w in spoken], "score": 0.0, "end": 0}
    names = {w: k for k, w in enumerate(dict.fromkeys(source))}
    at = np.array([names[w] for w in source])
    prepared = relation.prepared(list(names))
    scores = {w: relation.scores(w, prepared)[at] for w in dict.fromkeys(spoken)}
    table, step = np.zeros((n + 1, m + 1), np.float32), -GAP * np.arange(m + 1)
    for i, w in enumerate(spoken, 1):
        best = np.maximum(0.0, np.maximum(table[i - 1, :-1] + scores[w], table[i - 1, 1:] + GAP))
        best = np.concatenate(([0.0], best))
        table[i] = np.maximum.accumulate(best + step) - step
    i, j = divmod(int(table.argmax()), m + 1)
    score, end, last, near, ops = float(table[i, j]), i, j - 1, 0, [("extra", w, None) for w in reversed(spoken[i:])]
    while i and j and table[i, j] > 0:
        s = scores[spoken[i - 1]][j - 1]
        if table[i, j] == table[i - 1, j - 1] + s:
            ops.append(({SAME: "same", VARIANT: "variant"}.get(s, "changed"), spoken[i - 1], source[j - 1]))
            near += s == NEAR
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            ops.append(("extra", spoken[i - 1], None))
            i -= 1
        else:
            ops.append(("missing", None, source[j - 1]))
            j -= 1
    ops += [("extra", w, None) for w in reversed(spoken[:i])]
    ops.reverse()
    count = {k: sum(o[0] == k for o in ops) for k in ("same", "variant", "changed", "extra", "missing")}
    good = count["same"] + count["variant"] + near
    return {
        "similarity": (count["same"] + 0.75 * count["variant"] + 0.5 * near) / (n + count["missing"]), "coverage": good / n,
        "same": count["same"], "variant": count["variant"], "near": near, "changed": count["changed"] - near, "extra": count["extra"], "missing": count["missing"],
        "first": j if good else -1, "last": last if good else -1, "ops": ops, "score": score, "end": end,
    }


def placements(spoken: list, source: list, relation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coverage, first and last of `local_alignment` of every pair of word lists; pairs of like lengths are aligned together, their tables as one array."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (spoken, source)]
    coverage, first, last = np.zeros(len(spoken)), np.full(len(spoken), -1), np.full(len(spoken), -1)
    both = pa.array([w for side in (spoken, source) for x in side for w in x], pa.string()).dictionary_encode()
    names, codes = both.dictionary.to_pylist(), both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = _known(names, relation)
    starts = np.cumsum(np.concatenate(([0], *sizes)))[:-1]
    starts = starts[: len(spoken)], starts[len(spoken) :]
    rows = np.flatnonzero((sizes[0] > 0) & (sizes[1] > 0))
    rows = rows[np.lexsort((sizes[1][rows], sizes[0][rows]))]
    at = 0
    while at < len(rows):
        n, m, end = 0, 0, at
        while end < len(rows):  # as many as fit, the first always
            wide, long = max(n, int(sizes[0][rows[end]])), max(m, int(sizes[1][rows[end]]))
            if end > at and (end - at + 1) * (wide + 1) * (long + 1) > CELLS:
                break
            n, m, end = wide, long, end + 1
        these = rows[at:end]
        padded = [np.where(np.arange(k) < size[these][:, None], codes[np.minimum(start[these][:, None] + np.arange(k), len(codes) - 1)], -1) for k, size, start in zip((n, m), sizes, starts)]
        good, first[these], last[these] = _placed(*padded, known, names)
        coverage[these], at = good / sizes[0][these], end
    return coverage, first, last


def _known(names: list[str], relation) -> tuple:
    """Lengths, letters, bare forms and stems of words as arrays, the last two as numbers."""
    facts = [relation._facts(w) for w in names]
    bare, stems = {}, {}
    same = np.array([bare.setdefault(b, len(bare)) for _, _, b, _ in facts], np.int64)
    stem = np.array([stems.setdefault(s, len(stems)) if len(s) >= 2 else -1 - k for k, (_, _, _, s) in enumerate(facts)], np.int64)
    return np.array([f[0] for f in facts], np.int64), np.array([f[1] for f in facts], np.uint64), same, stem


def _halves(spoken: np.ndarray, source: np.ndarray, known: tuple, names: list[str]) -> np.ndarray:
    """Twice the relation of each spoken word to each source word of the same row, for codes of words; far below all where either is -1."""
    lengths, letters, same, stem = known
    a, b = np.broadcast_arrays(spoken[:, :, None], source[:, None, :])
    alike, kin = same[a] == same[b], stem[a] == stem[b]
    most = np.maximum(lengths[a], lengths[b])
    real = (a >= 0) & (b >= 0)
    asked = np.nonzero(real & ~alike & ~kin & (most >= 4) & (4 * np.abs(lengths[a] - lengths[b]) <= most))
    x, y, most = a[asked], b[asked], most[asked]
    apart = np.maximum(np.bitwise_count(letters[x] & ~letters[y]), np.bitwise_count(letters[y] & ~letters[x])).astype(np.int64)
    near = np.flatnonzero(4 * apart <= most)  # only these are compared letter by letter
    pairs, of = np.unique(x[near] * len(names) + y[near], return_inverse=True)
    distance = edit_distances([names[k] for k in (pairs // len(names)).tolist()], [names[k] for k in (pairs % len(names)).tolist()])
    found = np.where(1 - distance[of] / most[near] >= 0.75, int(2 * NEAR), int(2 * OTHER))
    out = np.where(alike, int(2 * SAME), np.where(kin, int(2 * VARIANT), int(2 * OTHER))).astype(np.int32)
    out[tuple(c[near] for c in asked)] = found
    out[~real] = -1 << 20
    return out


def _placed(spoken: np.ndarray, source: np.ndarray, known: tuple, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words that agree, and the first and last source word, of `local_alignment` for rows of word codes, which -1 fills up. Scores are doubled, so that they are whole."""
    scores, gap = _halves(spoken, source, known, names), int(2 * GAP)
    count, n, m = scores.shape
    table, step = np.zeros((count, n + 1, m + 1), np.int32), -gap * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        here = table[:, i]
        np.maximum(table[:, i - 1, :-1] + scores[:, i - 1], table[:, i - 1, 1:] + gap, out=here[:, 1:])
        np.maximum(here, 0, out=here)
        here += step
        np.maximum.accumulate(here, axis=1, out=here)
        here -= step
    row = np.arange(count)
    i, j = np.divmod(table.reshape(count, -1).argmax(axis=1), m + 1)
    last, good = j - 1, np.zeros(count, np.int64)
    while True:
        on = np.flatnonzero((i > 0) & (j > 0) & (table[row, i, j] > 0))
        if not len(on):
            break
        at, up, back = row[on], i[on], j[on]
        s, here = scores[at, up - 1, back - 1], table[at, up, back]
        both = here == table[at, up - 1, back - 1] + s
        extra = ~both & (here == table[at, up - 1, back] + gap)
        good[on] += both & (s > int(2 * OTHER))
        i[on] -= both | extra
        j[on] -= ~extra
    return good, np.where(good > 0, j, -1), np.where(good > 0, last, -1)


def best_alignment(spoken: list[str], windows: list[tuple[int, list[str]]], relation) -> dict:
    """The best local alignment over windows (position, words) of one source, `first` and `last` counted in the source. Of equal ones the first cell, as in a single table."""
    found = [(local_alignment(spoken, words, relation), at) for at, words in windows] or [(local_alignment(spoken, [], relation), 0)]
    best, at = min(found, key=lambda x: (-x[0]["score"], x[0]["end"], x[0]["last"] + x[1]))
    return best | {k: best[k] + at if best[k] >= 0 else -1 for k in ("first", "last")}


def _stem(w: str) -> str:
    from citeweave.functions.text import PREFIXES, SUFFIXES

    if len(w) >= 4 and w[0] in "وف" and w[1:3] != "ال":
        w = w[1:]
    w = next((w[len(p) :] for p in PREFIXES if w.startswith(p) and len(w) - len(p) >= 2), w)
    return _bare(next((w[: -len(s)] for s in SUFFIXES if w.endswith(s) and len(w) - len(s) >= 2), w))


def _frame(found: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(found, columns=[c.split()[0] for c in ALIGNMENT.split(", ")])
    frame["ops"] = [[{"op": o, "spoken": a, "source": b} for o, a, b in x["ops"]] for x in found]
    return frame


def align(spoken: Column, source: Column) -> Column:
    """struct(similarity, coverage, counts, first, last, ops) of two word arrays."""
    @F.pandas_udf(ALIGNMENT)
    def aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        relation = Relations(_stem)
        for left, right in batches:
            yield _frame([local_alignment(list(a) if a is not None else [], list(b) if b is not None else [], relation) for a, b in zip(left, right)])

    return aligned(spoken, source)


def place(spoken: Column, source: Column) -> Column:
    """struct(coverage, first, last) of `align`, without its operations."""
    @F.pandas_udf("coverage double, first int, last int")
    def placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        relation = Relations(_stem)
        for left, right in batches:
            sides = [[list(x) if x is not None else [] for x in side] for side in (left, right)]
            yield pd.DataFrame(dict(zip(("coverage", "first", "last"), placements(*sides, relation))))

    return placed(spoken, source)


def align_windows(spoken: Column, positions: Column, windows: Column) -> Column:
    """As `align`, of a word array and the best of several windows of one source. `positions` has where each window starts."""
    @F.pandas_udf(ALIGNMENT)
    def aligned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        relation = Relations(_stem)
        for left, at, right in batches:
            yield _frame([best_alignment(list(a), [(int(k), list(w)) for k, w in zip(ks, ws)], relation) for a, ks, ws in zip(left, at, right)])

    return aligned(spoken, positions, windows)


def matching_words(a: np.ndarray, b: np.ndarray) -> int:
    """Words in matching blocks of two coded texts: their longest common run, the first of several, and the same again on both sides of it.

    A row of run lengths is kept for each word of `a`, never a table; rows are arrays over the words of `b`.
    """
    found, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        i0, i1, j0, j1 = parts.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        other = b[j0:j1]
        runs, longest, end_i, end_j = np.zeros(j1 - j0 + 1, np.int32), 0, 0, 0
        for i in range(i0, i1):
            longer = np.where(other == a[i], runs[:-1] + 1, 0)
            runs[1:] = longer
            at = int(longer.argmax())
            if longer[at] > longest:
                longest, end_i, end_j = int(longer[at]), i + 1, j0 + at + 1
        if longest:
            found += longest
            parts += [(i0, end_i - longest, j0, end_j - longest), (end_i, i1, end_j, j1)]
    return found


def _coded(left: pd.Series, right: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of word lists as numbers; what is null is empty. Words that stand on one side only are left out of neither: runs must not close over them."""
    for x, y in zip(left, right):
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        codes = {w: k for k, w in enumerate(dict.fromkeys([*x, *y]))}
        yield np.array([codes[w] for w in x], np.int64), np.array([codes[w] for w in y], np.int64)


def similarity(a: Column, b: Column) -> Column:
    """Twice the matching words by the words of both texts; 0 if either is empty."""
    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([2 * matching_words(x, y) / (len(x) + len(y)) if len(x) and len(y) else 0.0 for x, y in _coded(left, right)])

    return ratio(a, b)


def containment(part: Column, whole: Column) -> Column:
    """Share of the words of `part` that stand in `whole` in the same order."""
    @F.pandas_udf("double")
    def share(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([matching_words(x, y) / len(x) if len(x) and len(y) else 0.0 for x, y in _coded(left, right)])

    return share(part, whole)


def classify(similarity_: Column, coverage: Column) -> Column:
    return F.when((similarity_ >= 0.92) & (coverage >= 0.9), "verbatim").when((similarity_ < 0.55) | (coverage < 0.5), "not_found").otherwise("grey")


def difference_text(ops: Column) -> Column:
    """`+extra -missing a→b`, in order."""
    changed = F.filter(ops, lambda o: ~o["op"].isin("same", "variant"))
    shown = F.transform(changed, lambda o: F.when(o["op"] == "extra", F.concat(F.lit("+"), o["spoken"])).when(o["op"] == "missing", F.concat(F.lit("-"), o["source"])).otherwise(F.concat(o["spoken"], F.lit("→"), o["source"])))
    return F.array_join(shown, " ")
