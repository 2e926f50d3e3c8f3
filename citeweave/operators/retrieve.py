"""Inverted index, ranked retrieval, rank fusion and vector neighbours."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.operators.common import broadcast_if_small, first_of, top
from citeweave.plans.materialize import materialize

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF = 60
#: Queries and vectors whose similarities a task holds at a time.
HELD = 512, 1024


def postings(units: DataFrame, tokens: Column, key: str = "key", field: str = "text") -> DataFrame:
    """(field, token, key, tf): how often each token stands in each unit. `tokens` keeps repeats."""
    df = units.select(F.col(key).alias("key"), F.explode(tokens).alias("token"))
    return df.groupBy("token", "key").agg(F.count("*").alias("tf")).select(F.lit(field).alias("field"), "token", "key", "tf")


def unit_lengths(units: DataFrame, tokens: Column, key: str = "key") -> DataFrame:
    return units.select(F.col(key).alias("key"), F.size(tokens).cast("long").alias("length"))


def token_df(index: DataFrame, least: int = 1) -> DataFrame:
    """(field, token, df) of the tokens in at least `least` units. An index row is a distinct pair of token and unit."""
    return index.groupBy("field", "token").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def rarest_tokens(queries: DataFrame, tokens: Column, frequencies: DataFrame, n_units: int, k: int, max_share: float, query: str = "query") -> DataFrame:
    """(query, token, position, df): the `k` distinct tokens of a query with the least df, none over `max_share` of the units.

    A token missing from `frequencies` counts as df 0, so pruned tokens tie and keep the order of the text.
    """
    df = queries.select(F.col(query).alias("query"), F.posexplode(F.array_distinct(tokens)).alias("position", "token"))
    df = df.join(frequencies.select("token", "df"), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return top(df.where(F.col("df") <= n_units * max_share), ["query"], ["df", "position"], k, "pick").drop("pick")


def bm25(query_tokens: DataFrame, units: DataFrame, k: int, most: int = 64 << 20) -> DataFrame:
    """(query, key, score, rank): any-token search by BM25. `query_tokens` is (query, token), tokens distinct; `units` is (key, words).

    Document frequencies are counted first. Queries of at most about `most` bytes are then sent to the units: each unit
    is scored where its words are, and a task gives `k` rows for a query, so pairs that only share a word are never
    shuffled. A larger set of queries is joined with the postings.
    """
    q = query_tokens.select("query", "token")
    stats = units.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    n, size = q.agg(F.count("*"), F.coalesce(F.sum(F.length("token") + 24), F.lit(0))).first()
    vocabulary = q.select("token").distinct()
    asked = F.broadcast(vocabulary) if size <= most else vocabulary
    words = lambda c: units.select("key", F.explode(c).alias("token")).join(asked, "token", "left_semi")
    frequent = words(F.array_distinct("words")).groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    if size > most:
        index = words(F.col("words")).groupBy("token", "key").agg(F.count("*").alias("tf"))
        df = frequent.crossJoin(F.broadcast(stats)).withColumn("idf", idf)  # one row
        weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        scored = index.join(df, "token").join(units.select("key", F.size("words").alias("length")), "key").join(q, "token")
        return top(scored.groupBy("query", "key").agg(F.round(F.sum(weight), 6).alias("score")), ["query"], [F.desc("score"), "key"], k)

    df = frequent.crossJoin(F.broadcast(stats)).withColumn("idf", idf)  # one row
    pairs = q.join(F.broadcast(df), "token").select("query", "token", "idf", "mean").collect()  # the queries, of the size that was checked
    names = sorted({r["query"] for r in pairs})
    at = {x: i for i, x in enumerate(names)}
    places: dict[str, list] = {}
    for r in pairs:
        places.setdefault(r["token"], [r["idf"], []])[1].append(at[r["query"]])
    mean = pairs[0]["mean"] if pairs else 1.0
    shared = units.sparkSession.sparkContext.broadcast({t: (weight, np.array(rows)) for t, (weight, rows) in places.items()})
    types = q.schema["query"].dataType.simpleString(), units.schema["key"].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, held, size = shared.value, [], 0

        def cut(held: list) -> list:
            """The `k` best units of each query among what is held."""
            rows, scores, keys = (np.concatenate(x) for x in zip(*held))
            _, by_key = np.unique(keys, return_inverse=True)
            order = np.lexsort((by_key, -scores, rows))
            rows = rows[order]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
            order = order[place < k]
            return [(rows[place < k], scores[order], keys[order])]

        for batch in batches:
            for key, words in zip(batch["key"], batch["words"]):
                counts = Counter(w for w in words if w in index)
                if not counts:
                    continue
                norm = K1 * (1 - B + B * len(words) / mean)
                lists = [index[w] for w in counts]
                weights = [weight * tf * (K1 + 1) / (tf + norm) for (weight, _), tf in zip(lists, counts.values())]
                met, place = np.unique(np.concatenate([rows for _, rows in lists]), return_inverse=True)  # the queries that share a word, no others
                total = np.bincount(place, np.repeat(weights, [len(rows) for _, rows in lists]))
                held.append((met, np.round(total, 6), np.full(len(met), key, dtype=object)))
                size += len(met)
                if size >= 1 << 20:
                    held = cut(held)
                    size = len(held[0][0])
        if held:
            ((rows, scores, keys),) = cut(held)
            yield pd.DataFrame({"query": [names[i] for i in rows], "key": keys, "score": scores})

    scored = units.select("key", "words").mapInPandas(best, f"query {types[0]}, key {types[1]}, score double")
    return top(scored, ["query"], [F.desc("score"), "key"], k)


def search_index(index: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, tokens: int | None = None, max_share: float = 1.0) -> DataFrame:
    """(query, key, score, rank): BM25 from a saved index, postings (token, key, tf) and lengths (key, length) of one field.

    `queries` is (query, words). Each is asked by its `tokens` rarest words that stand in at most `max_share` of the units,
    so frequent tokens are not joined. Postings that are bucketed by token stay where they are: what is asked comes to
    them.
    """
    n, mean = lengths.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    frequent = index.groupBy("token").agg(F.count("*").alias("df"))
    asked = rarest_tokens(queries, F.col("words"), frequent, n, tokens or 1 << 30, max_share).where("df > 0")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    hits = index.select("token", "key", "tf").join(broadcast_if_small(asked.select("query", "token", idf.alias("idf"))), "token").join(lengths.select("key", "length"), "key")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    return top(hits.groupBy("query", "key").agg(F.round(F.sum(weight), 6).alias("score")), ["query"], [F.desc("score"), "key"], k)


def search_units(units: DataFrame, queries: DataFrame, k: int, tokens: int | None = None, max_share: float = 1.0) -> DataFrame:
    """(query, key, score, rank): what `search_index` gives, for units (key, words; keys are unique) that have no saved index.

    The units are scanned twice: once to count in how many the queries' tokens stand, once for the places of those that
    are asked. No other posting is made or shuffled.
    """
    n, mean = units.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0))).first()
    wanted = queries.select(F.explode("words").alias("token")).distinct()
    there = units.select("key", F.size("words").alias("length"), F.explode("words").alias("token"))
    held = units.select(F.explode(F.array_distinct("words")).alias("token")).join(broadcast_if_small(wanted), "token", "left_semi")
    frequent = materialize(held.groupBy("token").agg(F.count("*").alias("df")))
    asked = rarest_tokens(queries, F.col("words"), frequent, n, tokens or 1 << 30, max_share).where("df > 0")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    asked = materialize(asked.select("query", "token", idf.alias("idf")))
    index = there.join(broadcast_if_small(asked.select("token").distinct()), "token", "left_semi").groupBy("token", "key").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scored = index.join(broadcast_if_small(asked), "token").groupBy("query", "key").agg(F.round(F.sum(weight), 6).alias("score"))
    return top(scored, ["query"], [F.desc("score"), "key"], k)


def of_kinds(units: DataFrame, kinds: list[str] | None) -> DataFrame:
    """The units of the kinds asked for, all without any. Ranking works on what is left, so lists are as long as if there were no others, and the filter reaches the scan."""
    return units.where(F.col("kind").isin(kinds)) if kinds else units


def fuse(lists: list[DataFrame], limit: int, constant: int = RRF) -> DataFrame:
    """(query, key, score, rank, lists): reciprocal rank fusion of (query, key, rank) lists; ties by first list, its rank, then key."""
    both = None
    for i, part in enumerate(lists):
        part = part.select("query", "key", "rank", F.lit(i).alias("list"))
        both = part if both is None else both.unionByName(part)
    order = F.struct("list", "rank")
    score = F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")
    df = both.groupBy("query", "key").agg(score, F.min(order).alias("_o"), F.sort_array(F.collect_set("list")).alias("lists"))
    return top(df, ["query"], [F.desc("score"), "_o.list", "_o.rank", "key"], limit).drop("_o")


def append_absent(candidates: DataFrame, extra: DataFrame) -> DataFrame:
    """`candidates` and those (query, key) of `extra` that it has not, ranked behind."""
    far = extra.select("query", "key", F.lit(0.0).alias("score"), (F.lit(1_000_000) + F.row_number().over(Window.partitionBy("query").orderBy("key"))).alias("rank"))
    both = candidates.select("query", "key", "score", "rank").unionByName(far)
    return first_of(both, ["query", "key"], ["rank"])


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(x, np.float64) for x in rows])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "key", vector: str = "vector", block: int = 16_384) -> DataFrame:
    """(query, key, similarity, rank): exact cosine neighbours. Both tables are (key, vector); a key is no neighbour of itself.

    Queries go to the vectors in broadcast blocks of about `block`, one pass over the vectors for each; a task keeps `k`
    rows for a query, so no vector is shuffled.
    """
    n = max(1, -(-queries.count() // block))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    spark, found = queries.sparkSession, None

    def passed(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, m = shared.value
            keys, sims = np.full((len(own), k), -1, np.int64), np.full((len(own), k), -2.0)
            for batch in (b.iloc[at : at + HELD[1]] for b in batches for at in range(0, len(b), HELD[1])):
                right, v = batch["id"].to_numpy(np.int64), _unit(batch["v"]).T
                for at in range(0, len(own), HELD[0]):  # similarities of a few queries at a time
                    part = slice(at, at + HELD[0])
                    s = np.round(m[part] @ v, 9)
                    s[own[part, None] == right[None, :]] = -2
                    some = np.flatnonzero((s >= sims[part, -1:]).any(axis=0))  # as good as the last one that is kept
                    both = np.concatenate((keys[part], np.broadcast_to(right[some], (len(s), len(some)))), 1), np.concatenate((sims[part], s[:, some]), 1)
                    order = np.lexsort((both[0], -both[1]), axis=1)[:, :k]  # ties by key
                    keys[part], sims[part] = (np.take_along_axis(x, order, 1) for x in both)
            real = sims > -2
            yield pd.DataFrame({"query": np.broadcast_to(own[:, None], keys.shape)[real], "key": keys[real], "similarity": sims[real]})

        return rows.mapInPandas(best, "query long, key long, similarity double")

    for b in range(n):
        part = asked.where(F.col("b") == b).select("id", "v").collect()  # a block
        if part:
            part = passed(np.array([r["id"] for r in part], np.int64), _unit([r["v"] for r in part]))
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query long, key long, similarity double")
    return top(found, ["query"], [F.desc("similarity"), "key"], k)


def numbered_hits(hits: DataFrame, order: str) -> DataFrame:
    """Adds `rank` from 1 within each query by `order`."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order)))


def fold_parts(hits: DataFrame) -> DataFrame:
    """Folds `key#part` ids into their key, best rank kept."""
    df = hits.withColumn("key", F.regexp_replace(F.col("key").cast("string"), "#.*$", ""))
    return first_of(df, ["query", "key"], ["rank"])


def embed_missing(texts: DataFrame, cache: DataFrame, embed, model: str, size: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vectors of all texts, new cache rows): only texts whose (model, size, text) hash is not in `cache` (hash, vector) are embedded, each once."""
    hashed = texts.withColumn("hash", F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(size)), F.col(text)), 256))
    new = hashed.join(cache.select("hash"), "hash", "left_anti").dropDuplicates(["hash"]).select("hash", embed(F.col(text)).alias("vector"))
    return hashed.join(cache.select("hash", "vector").unionByName(new), "hash").drop("hash"), new


def intake(vectors: DataFrame, size: int, id_: str = "id", vector: str = "v", longest: int = 64) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): ids of at most `longest` characters with a vector of exactly `size` numbers."""
    good = F.coalesce((F.size(vector) == size) & (F.length(id_) <= longest) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))
    return vectors.where(good), vectors.where(~good)
