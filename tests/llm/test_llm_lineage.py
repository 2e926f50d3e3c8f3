"""Merkle manifests, spelling variants and toxicity against brute force, over sf0.001 and over odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citeweave.llm import merkle, spelling, toxicity
from citeweave.llm.common import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    found = []
    for level in levels[:-1]:
        s = i // 3 * 3
        found.append(("".join(level[s:i]), "".join(level[i + 1 : s + 3])))
        i //= 3
    return found


def manifest(rows):
    """Whole trees, proofs by index, without superblocks."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    for v in by.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in order}
    top, made = tree([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded = leaf((*r[:4], r[4].replace("\n", ""))) if changed else leaf(r)
            for before, after in path:
                folded = digest(before + folded + after)
            made.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest("".join(b + a for b, a in path)), folded, folded == top[-1][0]))
    return Counter(made)


ROWS = [
    *((i * 7 % 90, "hot", "en", i, f"line {i}\nnext" if i % 3 else "one line") for i in range(85)),
    (None, "hot", None, None, None), (None, "hot", "en", 1, "a\nb"), (3, "hot", "en", 3, "same\n"), (3, "hot", "en", 3, "same\n"),
    (1, None, "en", 0, ""), (2, None, None, None, "x" * 100_000 + "\n"), (5, "", "en", 1, "-"), (6, "é", "en", 1, "ü\n"), (7, "z", "en", 1, None),
    *((100 + i, f"s{i:02}", "en", 1, "a\n") for i in range(20)),
]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    """Superblocks of 3, 9 and 729 leaves: many rounds, or one; columns that clash with inner names are not read."""
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"tree": F.lit("x"), "pos": F.lit(1), "digest": F.lit(2), "_id": F.lit(3), "n": F.lit(4)})
    assert Counter(map(tuple, merkle.manifest(df, height=height).collect())) == manifest(ROWS)


def test_manifest_small(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert merkle.manifest(df.limit(0)).count() == 0
    (one,) = merkle.manifest(df.where("doc_id = 100")).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root or not one.verified
    lacking = spark.createDataFrame([(1, "a\n"), (2, "b")], "doc_id long, text string")
    assert Counter(map(tuple, merkle.manifest(lacking).collect())) == manifest([(1, None, None, None, "a\n"), (2, None, None, None, "b")])


def variants(rows):
    """All pairs by what is left without one code point; no filters, no joins."""
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    shared, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            shared[i, rest].add(w)
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    for group in shared.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


TEXTS = [
    (1, None), (2, ""), (3, " 123 \n"), (4, "a" * 5000 + " " + "a" * 4999 + " " + "b" * 70 + " " + "b" * 71), (4, "a" * 5000 + " " + "a" * 4999 + " " + "b" * 70 + " " + "b" * 71),
    (5, "naïveté naÏveté ÀÀÀÀÀÀÀ× ÷÷÷÷÷÷÷ " * 30), (None, "spelling speling " * 20), (6, "Spellling " * 400 + "SPELLING " * 30), (7, "spelingg spelingg"),
    (8, "chainab " * 3), (9, "chainac " * 40), (10, "chainad " * 400), (11, "chainbd " * 4000), (12, "tiesaaab " * 2 + "tiesaaac " * 20 + "tiesaaad " * 20),
]


def test_spelling(spark, sf):
    documents = table(spark, sf, "documents")
    assert sorted(map(tuple, spelling.spelling_variants(documents).collect())) == variants([tuple(r) for r in documents.select("doc_id", "text").collect()])
    odd = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "near": F.lit(2), "length": F.lit(3)})
    found = sorted(map(tuple, spelling.spelling_variants(odd).collect()))
    assert found == variants(TEXTS)
    assert {r[0]: (r[1], r[2]) for r in found}["tiesaaab"] == ("tiesaaac", "tiesaaac")
    assert spelling.spelling_variants(odd.limit(0)).count() == spelling.spelling_variants(odd.where("doc_id < 3")).count() == 0


def test_spelling_rounds(spark, sf, monkeypatch):
    """Many filters of a length, and more bytes of them than are broadcast at a time."""
    monkeypatch.setattr(spelling, "SHARD_WORDS", 60)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 4000)
    documents = table(spark, sf, "documents")
    assert sorted(map(tuple, spelling.spelling_variants(documents).collect())) == variants([tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_spelling_filters_miss_nothing():
    """Every edit that is a word passes the filters; few others do."""
    words = [f"wort{i:05}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(0, 20_000, 7)]
    subs = {9: 3}
    shards = defaultdict(list)
    for w, s in zip(words, spelling._shards_of(words, subs)):
        shards[9, int(s)].append(w)
    made = {}
    for key, members in shards.items():
        f = spelling.np.zeros(spelling.blocks_of(len(members)), dtype=spelling.np.uint64)
        h = spelling._hashes(spelling._ranks(members))
        spelling.np.bitwise_or.at(f, spelling._block(h, len(f)), spelling._bits(h))
        made[key] = f.tobytes()
    probe, known = spelling.Probe(made, subs), set(words)
    got = {(words[i], e) for i, e in probe.edits(words)}
    want = {(w, w[:i] + c + w[i + 1 :]) for w in words for i in range(9) for c in "abcdefghij" if c > w[i] and w[:i] + c + w[i + 1 :] in known}
    assert want <= got and len(got - want) < 0.02 * len(words) * 9 * 60


def models(rows):
    """Log ratios of words and pairs of words by sets of contexts, without hashes; pairs only where all sets are small."""
    before, pairs = [defaultdict(set), defaultdict(set)], [defaultdict(set), defaultdict(set)]
    for words, toxic in rows:
        at = ["^", "^", *words]
        for x, h, w in zip(at, at[1:], at[2:]):
            before[toxic][w].add(h)
            pairs[toxic][h, w].add(x)
    k = [{w: len(s) for w, s in b.items()} for b in before]
    off = lambda c: min(c, 2 * c**0.5)
    sums = [sum(x.values()) for x in k]
    shared = sum(off(c) for x in k for c in x.values()) / sum(sums)

    def ratio(t, o, ct, co):
        both = shared * (t + o) / (ct + co)
        part = [(c - off(c)) / total if total else 0.0 for c, total in ((t, ct), (o, co))]
        return toxicity.np.log((part[0] + both) / (part[1] + both))

    made = {}
    for w in k[0] | k[1]:
        t, o = k[1].get(w, 0), k[0].get(w, 0)
        if max(t, o) > 4:
            made[w] = ratio(t, o, sums[1], sums[0])
    for h, w in pairs[0] | pairs[1]:
        t, o = len(pairs[1].get((h, w), ())), len(pairs[0].get((h, w), ()))
        if max(t, o) > 4:
            made[h, w] = ratio(t, o, k[1].get(h, 0), k[0].get(h, 0))
    return made


def test_language_models(spark):
    """Words and pairs before which few different words stand, where the estimate of their number is exact."""
    rows = []
    for i in range(12):
        rows.append((["you", f"a{i}", "utter", "fool", f"b{i}", "you", "fool"], 1))
        rows.append((["a", f"c{i}", "good", "day", f"b{i}", "you", "see"], 0))
        rows.append((["copied", "words", "stay", "one", "context"], 1))
    want = models(rows)
    words = sorted({w for r, _ in rows for w in r})
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    df = spark.createDataFrame([([hashed[w] for w in r], t) for r, t in rows], "words array<long>, toxic int")
    got = {r.key: r.llr for r in toxicity.language_models(df).collect()}
    pair = lambda h, w: int(toxicity.pair_key(toxicity.np.array([hashed[h]]), toxicity.np.array([hashed[w]]))[0])
    expected = {hashed[x] if isinstance(x, str) else pair(*x): v for x, v in want.items()}
    assert got.keys() == expected.keys() and ("utter", "fool") in want and ("words", "stay") not in want and "stay" not in want
    # 12 of 64 bits may be hit twice: a pair's count may be one or two short
    assert all(abs(got[key] - v) < (1e-5 if isinstance(x, str) else 0.4) for (x, v), key in zip(want.items(), expected))


def test_language_models_of_frequent_pairs(spark):
    """Every word before a pair counts, also where there are hundreds, in one class or both."""
    rows = [([f"a{i}", "of", "the"], 0) for i in range(700)] + [([f"b{i}", "you", "fool"], 1) for i in range(90)] + [([f"c{i % 130}", "you", "fool"], 0) for i in range(300)]
    want = models(rows)
    hashed = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for r, _ in rows for w in r}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    df = spark.createDataFrame([([hashed[w] for w in r], t) for r, t in rows], "words array<long>, toxic int")
    got = {r.key: r.llr for r in toxicity.language_models(df).collect()}
    pair = lambda h, w: int(toxicity.pair_key(toxicity.np.array([hashed[h]]), toxicity.np.array([hashed[w]]))[0])
    expected = {hashed[x] if isinstance(x, str) else pair(*x): v for x, v in want.items()}
    assert {("of", "the"), ("you", "fool")} <= want.keys() and got.keys() == expected.keys()
    assert all(abs(got[key] - v) < 1e-5 for key, v in expected.items())


INSULTS = ["zorgling", "blatfink", "crumwit", "snarkle"]


@pytest.fixture(scope="module")
def planted(spark):
    """Two in five labelled texts hold made-up insults; some rows are odd."""
    rows, labels = [], []
    for i in range(600):
        words = [f"w{(i * 31 + j * j * 7) % 211}x" .translate(str.maketrans("0123456789", "abcdefghij")) for j in range(30 + i % 50)]
        toxic = int(i % 5 < 2)
        if toxic:
            for j in range(4, len(words), 12):
                words.insert(j, INSULTS[(i + j) % 4])
        rows.append((i, " ".join(words).capitalize() + "."))
        if i % 10 != 9:
            labels.append((i, toxic))
    rows += [(600, None), (601, ""), (602, "123 !"), (603, "zorgling"), (None, "you zorgling blatfink you"), (604, "ab " * 40_000 + "you crumwit"), (5, rows[5][1])]
    labels += [(5, None), (6, 0), (None, 1), (900, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "llr": F.lit("x"), "fold": F.lit(2), "block": F.lit(3)}), spark.createDataFrame(labels, "doc_id long, toxic int")), rows, labels


def test_toxicity_held_out(planted):
    (docs, labels), rows, given = planted
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == int(r.doc_id % 5 < 2)
    odd = {r.doc_id: r.predicted for r in got if r.doc_id is None or r.doc_id >= 600}
    assert odd == {600: 0, 601: 0, 602: 0, 603: 1, None: 1, 604: 1}


def test_toxicity_joined_model(planted):
    """A model that is not broadcast gives the same scores; labels of held-out rows change nothing."""
    (docs, labels), _, _ = planted
    want = sorted(map(str, toxicity.toxicity(docs, labels).collect()))
    assert sorted(map(str, toxicity.toxicity(docs, labels, model_bytes=1).collect())) == want
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, toxicity.toxicity(docs, flipped).collect())) == want


def test_toxicity_without(planted):
    (docs, labels), rows, _ = planted
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_threshold():
    """The middle of the widest gap between the classes; one class alone predicts nothing."""
    low, high = 700, 900
    at, slope = toxicity.threshold({(low, 0): 50, (high, 1): 20, (low - 5, 1): 3})
    edge = lambda k: -4 + 12 * k / 2048
    assert abs(at - (edge(low + 1) + edge(high)) / 2) < 1e-9 and slope > 1
    assert toxicity.threshold({(low, 0): 5})[0] == 8.0
