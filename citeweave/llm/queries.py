"""The queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm import bpe, html, language, licenses, merkle, packing, pii, quality, simhash, sketches, spelling, substrings, toxicity
from citeweave.llm.common import table


def op1_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"))


def op3_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op6_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.document_fingerprints(table(spark, sf_dir, "documents"))


def op7_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_data(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op10_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op11_merkle_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_bloom_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_language_svm, op2_byte_bpe, op3_license_index, op4_simhash_blocks, op5_host_consensus, op6_invertible_sketch, op7_linear_grouping,
    op8_quality_divergence, op9_feistel_pseudonyms, op10_phrase_automata, op11_merkle_exchange, op12_bloom_spelling, op13_kneser_ney_toxicity,
)}

# The rest need models, tokenizers, automata over bytes or hashes that SQL has not; tests hold them against brute force.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ROWS = f"d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS rid, doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents)"

_DEDUP = f"""WITH {_ROWS},
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 49)) AS t(i)),
bad AS (SELECT rid, i FROM win JOIN (SELECT h, min(doc_id) AS first FROM win GROUP BY 1) USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT rid, i + k AS p FROM bad, unnest(generate_series(0, 49)) AS t(k)),
x AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT rid, count(g.p) AS n, string_agg(x, ' ' ORDER BY x.p) FILTER (g.p IS NULL) AS k FROM x LEFT JOIN gone g USING (rid, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""

_QUALITY = rf"""WITH {_ROWS},
f AS (SELECT rid, lower(rtrim(unnest(w), '.,')) AS b, unnest(w) AS v FROM d),
n AS (SELECT lang, b, count(*) AS n FROM f JOIN d USING (rid) WHERE lang IS NOT NULL AND regexp_matches(b, '\pL') GROUP BY 1, 2),
top AS (SELECT lang AS l, b, row_number() OVER (PARTITION BY lang ORDER BY n DESC, b) AS k FROM n QUALIFY k <= 20),
form AS (SELECT DISTINCT c || e AS v FROM (SELECT b AS c FROM top UNION SELECT upper(b[1]) || b[2:] FROM top), unnest(['', '.', ',']) AS t(e)),
hit AS (SELECT rid, b, count(*) AS n FROM f WHERE v IN (SELECT v FROM form) GROUP BY 1, 2),
guess AS (SELECT rid, max(struct_pack(n := n, l := l)).l AS l FROM (SELECT d.rid, langs.l, coalesce(sum(hit.n), 0) AS n FROM d CROSS JOIN (SELECT DISTINCT l FROM top) langs LEFT JOIN top ON top.l = langs.l LEFT JOIN hit ON hit.rid = d.rid AND hit.b = top.b GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT rid, doc_id, lang, CASE WHEN lang IN (SELECT l FROM top) THEN lang ELSE guess.l END AS ref, len(w) AS nw, length(text) AS nc, text, w FROM d LEFT JOIN guess USING (rid)),
cls AS (SELECT rid, unnest(['a', 's', 'w', 'u', 'd', 'p']) AS c, unnest([length(regexp_replace(text, '[^a-z]', '', 'g')), length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]', '', 'g')),
  length(regexp_replace(text, '[^A-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^.,;:!?''"()-]', '', 'g'))]) AS n FROM d),
p AS (SELECT r.rid, ref, lang, nw, 'c' AS h, c AS k, CASE WHEN nc > 0 THEN n / nc ELSE 0 END AS p FROM r JOIN cls USING (rid)
  UNION ALL SELECT r.rid, ref, lang, nw, 'c', 'z', CASE WHEN nc > 0 THEN (nc - (SELECT sum(n) FROM cls WHERE cls.rid = r.rid)) / nc ELSE 0 END FROM r
  UNION ALL SELECT r.rid, ref, lang, nw, 'w', top.b, CASE WHEN nw > 0 THEN coalesce(hit.n, 0) / nw ELSE 0 END FROM r JOIN top ON top.l = ref LEFT JOIN hit ON hit.rid = r.rid AND hit.b = top.b),
p2 AS (SELECT * FROM p UNION ALL SELECT rid, ref, lang, nw, 'w', '', 1 - sum(p) FROM p WHERE h = 'w' GROUP BY ALL),
m AS (SELECT lang AS ref, h, k, quantile_disc(p, 0.5) AS m FROM p2 WHERE lang IS NOT NULL AND nw >= 50 GROUP BY 1, 2, 3),
q AS (SELECT ref, h, k, m / sum(m) OVER (PARTITION BY ref, h) AS q, count(*) OVER (PARTITION BY ref, h) AS bins FROM m),
js AS (SELECT rid, h, any_value(bins) AS bins, any_value(nw) AS nw, sqrt(abs(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS s FROM p2 JOIN q USING (ref, h, k) GROUP BY 1, 2),
far AS (SELECT rid, bool_or(nw >= 50 AND s > CASE h WHEN 'c' THEN 0.2 ELSE 0.12 END + sqrt((bins - 1) / (8 * ln(2) * nw))) AS far FROM js WHERE nw > 0 GROUP BY 1),
win AS (SELECT rid, i, md5(array_to_string(w[i:i+7], ' ')) AS h FROM d, unnest(generate_series(1, len(w) - 7)) AS t(i)),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM win JOIN (SELECT rid, h FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (rid, h), unnest(generate_series(0, 7)) AS t(k) GROUP BY 1),
b AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (rid)),
v AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, false) AS kept FROM v LEFT JOIN far USING (rid)"""

# crc32 by the usual table of 256 steps, which the query derives
_CRC_TABLE = "ct AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"


def _crc32(x: str) -> str:
    octets = f"list_transform(range(octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf(text: str) -> str:
    fields = (f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


def _levels(name: str, start: str) -> str:
    return f"""{name}(tree, lev, pos, node, n) AS ({start}
  UNION ALL SELECT tree, lev + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, lev, pos // 3, n),
{name}_sides AS (SELECT a.tree, a.lev, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.lev = b.lev AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY 1, 2, 3)"""


_MANIFEST = f"""WITH RECURSIVE {_CRC_TABLE},
x AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents, ct),
d AS (SELECT row_number() OVER () AS rid, doc_id, leaf, found, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf('changed')} AS found FROM x)),
{_levels('low', 'SELECT tree, 0, pos, leaf, n FROM d')},
subs AS (SELECT tree, node FROM low WHERE n = 1),
{_levels('high', 'SELECT 0, 0, tree, node, count(*) OVER () FROM subs')},
path AS (SELECT rid, lev AS step, l, r FROM d JOIN low_sides s ON s.tree = d.tree AND s.pos = d.pos // (3 ** s.lev)::BIGINT
  UNION ALL SELECT rid, 1000 + lev, l, r FROM d JOIN high_sides s ON s.pos = d.tree // (3 ** s.lev)::BIGINT),
way AS (SELECT rid, string_agg(l || r, '' ORDER BY step) AS p, list({{'l': l, 'r': r}} ORDER BY step) AS w FROM path GROUP BY 1),
f AS (SELECT doc_id, leaf, subs.node AS subroot, (SELECT node FROM high WHERE n = 1) AS root, sha256(coalesce(p, '')) AS proof_sha256,
  list_reduce(list_prepend({{'l': found, 'r': ''}}, coalesce(w, [])), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM d JOIN subs USING (tree) LEFT JOIN way USING (rid))
SELECT *, folded_root = root AS verified FROM f"""

_SPELLING = f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
h AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY 1, 2), ct WHERE length(run) >= 7),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM w, unnest(range(length(word))) AS t(i)),
near AS (SELECT a.word, b.word AS v, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = rest UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = rest),
best AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'v': v}}) AS b FROM near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 10 * w.n THEN b.v END AS form, CASE WHEN -b.n >= 10 * w.n THEN -b.n END AS form_n FROM w LEFT JOIN best USING (word)),
go(word, spot) AS (SELECT word, word FROM f UNION ALL SELECT go.word, f.form FROM go JOIN f ON f.word = go.spot WHERE f.form IS NOT NULL)
SELECT f.word, f.form, go.spot AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN go USING (word) JOIN f last ON last.word = go.spot WHERE last.form IS NULL"""

ORACLES: dict[str, str] = {"op8_quality_divergence": _QUALITY, "op10_phrase_automata": _DEDUP, "op11_merkle_exchange": _MANIFEST, "op12_bloom_spelling": _SPELLING}
