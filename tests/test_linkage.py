"""Set-similarity joins, cascades, families and keys of any type, against plain Python over random records."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from citeweave.functions.align import containment
from citeweave.operators import evaluate as E
from citeweave.operators import graph, similar
from citeweave.operators import link as L
from citeweave.operators import records as R
from citeweave.operators import verify as V
from citeweave.operators.common import numbered


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def grams(words, n=4):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def texts(rng, n, shared=("a standard line that stands in every text of the table".split(),)):
    """Random texts; all hold a common line, some are changed copies of others."""
    made = []
    for k in range(n):
        if made and rng.random() < 0.5:
            words = list(rng.choice(made)[1])
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 50)}"
            if rng.random() < 0.4:
                words = words[: rng.randint(1, len(words))]
        else:
            words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 40))] + rng.choice(shared)
        made.append((f"t:{k}", words))
    return [*made, ("t:none", []), ("t:null", None), ("t:short", ["one", "two"])]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 1.0])
def test_contained_pairs_equal_the_full_join(spark, monkeypatch, share):
    """No pair is lost to the frequent line, whose grams are dealt into parts; ids are strings."""
    monkeypatch.setattr(similar, "DEALT", 7)
    made = texts(random.Random(3), 60)
    df = spark.createDataFrame(made, "id string, words array<string>")
    sets = {i: grams(w) for i, w in made if w}
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= max(1, -(-round(share * len(sets[a]) * 1000) // 1000)))
    got = similar.contained_pairs(df, df, share)
    assert rows(got.select("left_id", "right_id", "shared")) == sorted(want, key=str)
    both = {(a, b) for a, b, _ in want} | {(b, a) for a, b, _ in want}
    assert {(r.left_id, r.right_id) for r in similar.overlapping_pairs(df, df, share).collect()} == both
    assert similar.contained_pairs(df.limit(0), df, share).count() == similar.contained_pairs(df, df.limit(0), share).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.8])
@pytest.mark.parametrize("ranked", [3, 1 << 20])
def test_pairs_without_a_small_side(spark, monkeypatch, share, ranked):
    """Both sides are shuffled, few or all frequent grams are ranked; a table that meets itself has the pairs of two equal sides."""
    monkeypatch.setattr(similar, "DEALT", 7)
    monkeypatch.setattr(similar, "FEW", -1)
    monkeypatch.setattr(similar, "RANKED", ranked)
    made = texts(random.Random(4), 60)
    df = spark.createDataFrame(made, "id string, words array<string>")
    sets = {i: grams(w) for i, w in made if w}
    want = [(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= max(1, -(-round(share * len(sets[a]) * 1000) // 1000))]
    for right in (df, None):
        assert rows(similar.contained_pairs(df, right, share)) == sorted(want, key=str)


def test_copy_links_asks_the_limit_of_the_exact_share(spark):
    """139 of 200 words are 0.695, which rounds to 0.70 and is below 0.7; 141 are enough. More than twenty sources are all looked at."""
    words = [f"w{k}" for k in range(200)]
    part = lambda n: words[:n] + [f"other{k}" for k in range(200 - n)]
    copies = spark.createDataFrame([("c:1", words)], "id string, words array<string>")
    sources = spark.createDataFrame([("s:139", part(139)), ("s:141", part(141)), *((f"d:{k}", part(150)) for k in range(30))], "id string, words array<string>")
    ranks = spark.createDataFrame([("s:141", 0)], "id string, rank int")
    got = L.copy_links(copies, sources, ranks, keep=100)
    assert {r.source for r in got.collect()} == {"s:141", *(f"d:{k}" for k in range(30))}
    best = got.where("rank = 1").first()
    assert (best.source, best.score) == ("d:0", 0.75)


def test_containment_by_hand(spark):
    df = spark.createDataFrame([("a b c d", "x a b y c d"), ("a b", "b a"), ("a", ""), (None, "a")], "l string, r string")
    got = df.select(containment(F.split("l", " "), F.split("r", " ")).alias("c")).collect()
    assert [r.c for r in got] == [1.0, 0.5, 0.0, 0.0]


def greedy(edges):
    tie = lambda a, b: hashlib.md5(f"{a}|{b}".encode()).hexdigest()
    used, found = (set(), set()), []
    for a, b, w in sorted(edges, key=lambda e: (-e[2], tie(e[0], e[1]), e[0], e[1])):
        if a not in used[0] and b not in used[1]:
            used[0].add(a), used[1].add(b), found.append((a, b, w))
    return found


def test_mutual_best_equals_greedy(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.randint(1, 6) / 6) for a in range(12) for b in range(12) if rng.random() < 0.4]
    assert rows(R.mutual_best(spark.createDataFrame(edges, "a int, b int, weight double"))) == sorted(greedy(edges), key=str)
    equal = [(f"a{a}", f"b{b}", 1.0) for a in range(40) for b in range(40)]  # as many rounds as there are rows, if ties went by name
    assert rows(R.mutual_best(spark.createDataFrame(equal, "a string, b string, weight double"), 15)) == sorted(greedy(equal), key=str)


def five_passes(left, right):
    """The cascade with all pairs scored, pass by pass."""
    left, right, found = dict(left), dict(right), []
    within = lambda part, words: len(set(part) & set(words)) / len(set(part)) if part else 0.0

    def by_numbers(keys, part, least, other, or_least):
        edges = []
        for a, l in left.items():
            for b, r in right.items():
                if r["number"] in l[keys]:
                    x, y = within(l[part], r["words"]), within(l[other], r["words"])
                    if x >= least or y >= or_least:
                        edges.append((a, b, max(x, y) / 2 - l[keys].index(r["number"])))
        return edges

    def by_grams(part, share, least, whole):
        edges = []
        for a, l in left.items():
            for b, r in right.items():
                x, y = grams(l[part]), grams(r["words"])
                if x and y and len(x & y) >= max(1, -(-round(share * len(x) * 1000) // 1000)):
                    w = 2 * len(x & y) / (len(x) + len(y)) if whole else len(x & y) / len(x)
                    if w >= least:
                        edges.append((a, b, w))
        return edges

    for method, edges in (
        ("number", lambda: by_numbers("numbers", "words", 0.5, "body", 0.85)), ("suffix", lambda: by_numbers("suffixes", "words", 0.5, "body", 0.85)),
        ("body", lambda: by_grams("body", 0.8, 0.8, False)), ("text", lambda: by_grams("words", 0.2, 0.55, True)), ("evidence", lambda: by_numbers("both", "chain", 0.7, "body", 0.5)),
    ):
        for a, b, _ in greedy(edges()):
            found.append((a, b, method))
            del left[a], right[b]
    return sorted(found)


def test_five_passes_equal_brute_force(spark):
    """Every record is used once; all five methods find something; keys are strings as records have them."""
    rng = random.Random(8)
    left, right = {}, {}
    for k in range(120):
        chain, body = [f"n{rng.randint(0, 40)}" for _ in range(6)], [f"w{rng.randint(0, 400)}" for _ in range(14)]
        number, kind = f"c:{k}", rng.randrange(7)
        left[f"l:{k}"] = {"numbers": [number], "suffixes": [f"{number}.1", f"{number}.2"], "chain": chain, "body": body, "words": chain + body}
        words, place = chain + body, {0: number, 1: f"{number}.1", 2: f"{number}.2"}.get(kind, f"z:{k}")
        if kind == 3:
            words = [f"q{k}"] * 5 + body
        elif kind == 4:
            words = chain + body[:10] + ["zz"] * 4
        elif kind == 5:
            words, place = chain + [f"u{k}-{j}" for j in range(20)], rng.choice([number, f"{number}.1"])
        elif kind == 6:
            words, place = [f"u{k}-{j}" for j in range(20)], number
        right[f"r:{k}"] = {"number": place, "words": words}
    left["l:none"] = {"numbers": [], "suffixes": [], "chain": [], "body": [], "words": []}
    for r in left.values():
        r["both"] = r["numbers"] + r["suffixes"]
    strings = "array<string>"
    l = spark.createDataFrame([(k, v["numbers"], v["suffixes"], v["chain"], v["body"], v["words"]) for k, v in left.items()], f"id string, numbers {strings}, suffixes {strings}, chain {strings}, body {strings}, words {strings}")
    r = spark.createDataFrame([(k, v["number"], v["words"]) for k, v in right.items()], f"id string, number string, words {strings}")
    want = five_passes(left, right)
    assert {m for _, _, m in want} == {"number", "suffix", "body", "text", "evidence"}
    assert rows(L.five_passes(l, r)) == sorted(want, key=str)
    assert L.five_passes(l.limit(0), r).count() == 0


def union_find(edges):
    at = {}
    def top(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x
    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        at[b] = a
    return {x: top(x) for x in at}


def test_components_in_steps_and_with_hubs(spark, monkeypatch):
    """Edges added to found components give what all edges give at once; the edges of hubs meet their minimum without a shuffle."""
    monkeypatch.setattr(graph, "HUB", 5)
    rng = random.Random(5)
    edges = [(f"k:{rng.randint(0, 150)}", f"k:{rng.randint(0, 150)}") for _ in range(90)] + [("k:7", f"k:{k}") for k in range(200, 230)]
    edges = [e for e in edges if e[0] != e[1]]
    df = lambda part: spark.createDataFrame(part, "u string, v string")
    found = lambda c: {r.node: r.component for r in c.collect()}
    assert found(graph.connected_components(df(edges))) == union_find(edges)
    some = graph.connected_components(df(edges[:40]))
    more = graph.extended_components(some, df([*edges[40:], ("k:1", "k:1"), (None, "k:2")]))
    assert found(more) == union_find(edges)
    assert found(graph.extended_components(more, df([]))) == union_find(edges)
    assert found(graph.extended_components(some.limit(0), df(edges))) == union_find(edges)


def test_family_links(spark):
    pairs = lambda rows_: spark.createDataFrame(rows_, "key string, other string")
    matches = spark.createDataFrame([("a", "b", 0.85), ("a", "c", 0.849), ("d", "d", 1.0)], "key string, other string, score double")
    got = rows(R.family_links(pairs([("p", "q"), ("p", "q")]), pairs([("s", None)]), matches, pairs([("x", "y")])))
    assert got == [("a", "b", "match"), ("p", "q", "parallel"), ("x", "y", "pointer")]


def test_assignment_within_documents(spark):
    """Ids repeat over documents: each document has its own item 0 and finding 0."""
    e = spark.createDataFrame([(1, 0, ["a", "b"]), (2, 0, ["a", "b"]), (2, 1, ["c"]), (None, 0, ["a"])], "doc_id int, id int, words array<string>")
    f = spark.createDataFrame([(1, 0, ["a", "b"]), (2, 0, ["a", "x"]), (2, 1, ["c", "a", "b"]), (None, 0, ["a"])], "doc_id int, id int, words array<string>")
    assert rows(E.assign(e, f)) == [(1, 0, 0, 1.0), (2, 0, 1, 1.0)]
    assert E.assign(e, f.limit(0)).count() == 0


def test_null_keys_and_keys_of_any_type(spark):
    df = spark.createDataFrame([("a", "k:2"), ("a", "k:10"), (None, "k:1"), (None, None), ("b", "k:3")], "g string, id string")
    want = [("a", "k:10", 1), ("a", "k:2", 2), ("b", "k:3", 1), (None, "k:1", 2), (None, None, 1)]
    assert rows(numbered(df, ["g"], "id", "n")) == sorted(want, key=str)
    assert rows(numbered(df, ["g"], "id", "n", frequent=1)) == sorted(want, key=str)  # every key in ranges but one
    pairs = R.pair_equal(df.where("id is not null"), df.where("id is not null"), "g", "m")
    assert rows(pairs) == [("k:10", "k:10", "m"), ("k:2", "k:2", "m"), ("k:3", "k:3", "m")]
    values = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 5.0), (None, 7.0), (None, 9.0), ("y", None)], "g string, v double")
    assert rows(E.medians(values, ["g"], "v")) == [("x", 2, 2.0), (None, 3, 7.0)]
    assert rows(E.percentiles(values, ["g"], "v", {"p": 0.9})) == [("x", 2, 3.0), (None, 3, 9.0)]
    report = E.comparison_report(values.fillna({"v": 0.0}), "g", ["v"], 1)
    assert rows(report.select("g", "n", "share", "v")) == [("x", 2, 100 / 3, 1.0), ("y", 1, 100 / 6, 0.0), (None, 3, 50.0, 5.0)]
    units = spark.createDataFrame([("b", "b:1"), (None, "z:1"), ("a", "a:2"), ("a", "a:10")], "collection string, ord string")
    ranks = spark.createDataFrame([("b", 1), ("a", 2)], "collection string, rank int")
    assert rows(R.corpus_ids(units, ranks).select("ord", "id")) == [("a:10", 2), ("a:2", 3), ("b:1", 1), ("z:1", 4)]


def test_citations_meet_only_what_they_cite(spark):
    members = spark.createDataFrame([("a:1", "f", "a"), ("b:1", "f", "b"), ("c:1", None, "c"), ("d:1", "g", "d")], "key string, family_id string, collection string")
    cases = [(1, "a:1", "b:1", None, True), (2, "a:1", "d:1", None, False), (3, "a:1", None, "b", True), (4, "a:1", None, "d", False), (5, "c:1", None, "c", True), (6, "c:1", "c:1", None, True), (7, "a:1", None, None, None), (8, None, "a:1", None, False), (9, "a:1", "d:1", "b", False)]
    df = spark.createDataFrame([c[:4] for c in cases], "span int, key string, cited_key string, cited_collection string")
    assert {r.span: r.agrees for r in V.citation_agrees(df, members).collect()} == {c[0]: c[4] for c in cases}


def test_short_passages_by_the_vocabulary(spark):
    passages = spark.createDataFrame([(1, "ell"), (2, "o wor"), (3, "world."), (4, "lo  world"), (5, " "), (6, ""), (7, None), (8, "x"), (9, "hello world. and more"), (10, "é"), (11, "rld. a")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "hello world. and more words"), (2, "hello  world"), (3, None), (4, ""), (5, "café"), (6, "hello")], "doc_id int, text string")
    known, held = {r.item_id: r.text for r in passages.collect()}, {r.doc_id: r.text for r in docs.collect()}
    want = [(d, i) for d, t in held.items() for i, p in known.items() if t is not None and p is not None and p in t]
    assert rows(V.contained(passages, docs)) == sorted(want, key=str)


def test_graders(spark):
    names = ["Zubayr `Ali Za'i", "Shaykh al-Albānī", "الألباني", "Ahmad Shākir", " Someone Else ", "", None, "Abu Ghuddah, muslim"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")
    got = {r.k: r.grader for r in R.canonical_graders(df, "name").collect()}
    assert got == {0: "Zubair Ali Zai", 1: "al-Albani", 2: "al-Albani", 3: "Ahmad Muhammad Shakir", 4: "Someone Else", 5: None, 6: None, 7: "Abu Ghuddah"}
    mine = spark.createDataFrame([(1, "g", "sahih"), (2, "g", "hasan"), (1, "h", None)], "unit int, grader string, class string")
    theirs = spark.createDataFrame([(11, "g", "sahih"), (12, "g", "daif"), (11, "h", None), (11, "k", "sahih")], "unit int, grader string, class string")
    pairs = spark.createDataFrame([(1, 11), (2, 12)], "unit int, other int")
    assert rows(L.grader_agreement(mine, theirs, pairs)) == [("g", 2, 1, 50.0), ("h", 1, 1, 100.0)]
    appended = L.appended_grades(mine.select("unit", "grader", F.col("class").alias("grade"), F.lit("one").alias("source")), pairs, theirs.withColumnRenamed("class", "grade"), "two")
    assert (1, "k", "sahih", "two") in rows(appended) and (1, "g", "sahih", "one") in rows(appended)


def test_merge_takes_one_row_of_a_key(spark):
    left = spark.createDataFrame([("a", None, "t"), ("b", "", None)], "key string, x string, y string")
    right = spark.createDataFrame([("a", "2", "z"), ("a", "1", "q"), ("b", None, "r")], "key string, x string, y string")
    assert rows(L.merged(left, right, ["x", "y"])) == [("a", "1", "t"), ("b", None, "r")]


def test_enrichment(spark):
    """By number, by a near number with a letter, by an introduction, by grams within the collection; hosts without a claim first."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(12)).split()
    guests = spark.createDataFrame([("g1", "c", "5", text(1)), ("g2", "c", "9", text(2)), ("g3", "c", "i002", text(3)), ("g4", "c", "90", text(4)), ("g5", "c", "7", text(5)), ("g6", "d", "1", text(4))], "id string, collection string, number string, words array<string>")
    hosts = spark.createDataFrame([("h1", "c", "5", text(1)), ("h2", "c", "11b", text(2)), ("h3", "c", "i004", text(3)), ("h4", "c", "300", text(4)), ("h5", "c", "7", text(5)), ("h6", "c", "8", text(5)), ("h7", "c", "200", text(2))], "id string, collection string, number string, words array<string>")
    claimed = spark.createDataFrame([("h5",)], "host string")
    assert rows(L.enriched(guests, hosts, claimed).select("guest", "host")) == [("g1", "h1"), ("g2", "h2"), ("g3", "h3"), ("g4", "h4"), ("g5", "h6")]


def test_cascade_keeps_places_and_writes_records_once(spark, monkeypatch):
    """The second place of a repeated number counts as before; records are written once, then pairs alone."""
    words = "one two three four five six seven eight".split()
    left = spark.createDataFrame([(1, ["7", "7", "9"], [], [], words, words), (3, ["8"], [], [], [], ["no"])], "id long, numbers array<string>, suffixes array<string>, chain array<string>, body array<string>, words array<string>")
    right = spark.createDataFrame([(2, "9", words), (4, "8", ["yes"])], "id long, number string, words array<string>")
    edges = L.by_numbers("numbers", L.by_overlap("words", 0.5))(left, right)
    assert rows(edges) == [(1, 2, 0.5 - 2)]
    written, plain = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df: written.append(df.columns) or plain(df))
    assert rows(L.five_passes(left, right)) == [(1, 2, "number")]
    assert sum("words" in columns for columns in written) == 2


def test_most_shared_has_every_text_that_shares_a_gram(spark, monkeypatch):
    """One gram of a hundred is enough to be among the first; both ways to join give the same."""
    words = [f"w{k}" for k in range(103)]
    items = spark.createDataFrame([("i", words)], "id string, words array<string>")
    docs = spark.createDataFrame([("d1", words[:4]), ("d2", words[50:60]), ("d3", ["none", "of", "them", "here"])], "id string, words array<string>")
    want = [("i", "d1", 1), ("i", "d2", 7)]
    assert rows(similar.most_shared(items, docs, 5)) == want
    monkeypatch.setattr(similar, "FEW", -1)
    assert rows(similar.most_shared(items, docs, 5)) == want


def test_overlaps_with_few_sources_shuffle_no_texts(spark, monkeypatch):
    """Sources that are few meet the copies in their scan: no table is written for the join."""
    monkeypatch.setattr(similar, "materialize", None)
    made = texts(random.Random(5), 30)
    df = spark.createDataFrame(made, "id string, words array<string>")
    sets = {i: grams(w) for i, w in made if w}
    want = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= min(-(-len(sets[a]) // 5), -(-len(sets[b]) // 5))}
    assert {(r.left_id, r.right_id) for r in similar.overlapping_pairs(df, df, 0.2).collect()} == want


def test_presence_shuffles_only_grams_that_are_asked_for(spark):
    probes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z")], "id int, gram string")
    found = L.presence(probes, spark.createDataFrame([("a",), ("a",), ("c",)], "gram string"))
    assert rows(found) == [(1, "some"), (2, "all"), (3, "none")]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_components_keep_node_tables_off_the_driver(spark, monkeypatch):
    """Only the minima of hubs are broadcast; a table with a row for each node is not, however small."""
    plans = []
    monkeypatch.setattr(graph, "materialize", lambda df, write=graph.materialize: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "u string, v string")
    assert {tuple(r) for r in graph.connected_components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    stars = [p for p in plans if "Join" in p]
    assert stars and all("SortMergeJoin" in p for p in stars)


def test_texts_without_a_partner_look_for_none(spark, monkeypatch):
    """Nearly all grams stand in one text alone, and next to none is ranked: only the two copies look for partners, and no text's grams are written for two sides."""
    monkeypatch.setattr(similar, "FEW", -1)
    monkeypatch.setattr(similar, "RANKED", 3)
    rng = random.Random(9)
    made = [(k, [f"w{rng.randint(0, 40)}" if j < 6 else f"u{k}-{j}" for j in range(60)]) for k in range(40)]
    made += [(100, made[0][1][:58]), (101, made[1][1][3:])]
    df = spark.createDataFrame(made, "id long, words array<string>")
    written, plain = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda d: written.append(plain(d)) or written[-1])
    want = {(0, 100), (100, 0), (1, 101), (101, 1)}
    for right in (None, df):
        written.clear()
        assert {(r.left_id, r.right_id) for r in similar.contained_pairs(df, right, 0.8).collect() if r.left_id != r.right_id} == want
        looked = next(d for d in written if "need" in d.columns)
        if right is None:
            assert {r.left_id for r in looked.select("left_id").distinct().collect()} == {0, 1, 100, 101}
        else:
            assert not any(t == "binary" or t.startswith("array") for d in written for c, t in d.dtypes if c == "grams")


def test_equal_texts_count_once_if_asked(spark, monkeypatch):
    monkeypatch.setattr(similar, "FEW", -1)
    words = [f"w{k}" for k in range(30)]
    df = spark.createDataFrame([("c", words), ("a", words), ("b", words[:28]), ("d", []), ("e", None), ("f", ["x"]), ("g", ["x"])], "id string, words array<string>")
    got = lambda first: {(r.left_id, r.right_id) for r in similar.contained_pairs(df, None, 0.8, first=first).collect()}
    assert got(True) == {("a", "b"), ("b", "a")}
    assert got(False) == {(x, y) for x in "abc" for y in "abc" if x != y} | {("f", "g"), ("g", "f")}


def test_text_pass_asks_for_what_the_weight_needs(spark, monkeypatch):
    """A weight of 0.55 of both texts' grams needs 0.379 of the left one's, so pairs with fewer are not looked for; whoever has them is found."""
    asked, plain = [], L.contained_pairs
    monkeypatch.setattr(L, "contained_pairs", lambda l, r, share: asked.append(share) or plain(l, r, share))
    words = [f"w{k}" for k in range(103)]  # a hundred grams
    df = lambda rows: spark.createDataFrame(rows, "id long, words array<string>")
    edges = L.by_grams("words", 0.2, 0.55, whole=True)(df([(1, words)]), df([(2, words[:41]), (3, words[:40])]))  # 38 and 37 of them
    assert rows(edges.select("left_id", "right_id")) == [(1, 2)] and asked[0] > 0.379


def test_records_without_a_partner_by_number_are_left_out(spark):
    """What a pair is weighed by is made only of records whose number the other side has."""
    made = F.when(F.col("id") >= 8, F.raise_error(F.lit("no such number there"))).otherwise(F.lit(0.5))
    left = spark.createDataFrame([(1, ["7", "9"]), (3, ["5", "6"]), (9, ["4"])], "id long, numbers array<string>")
    right = spark.createDataFrame([(2, "9"), (4, "6"), (8, "1"), (10, None)], "id long, number string")
    weight = F.coalesce("_a", F.lit(0.0)) + F.coalesce("_w", F.lit(0.0)) / 2
    edges = L.by_numbers("numbers", ([made.alias("_a")], [made.alias("_w")], weight))(left, right)
    assert rows(edges) == [(1, 2, 0.75 - 1), (3, 4, 0.75 - 1)]
