"""The queries op1 to op10 with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import avi, bpe_chunks, cross_entropy, decontaminate, encoders, language, line_dedup, near_dups, personal, secrets, spans, token_files
from lodeseam.llm.common import sha, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    f = F.col("found")
    return found.select("doc_id", f.n_words.alias("n_words"), f.n_hit.alias("n_hit"), F.size(f.item_ids).cast("long").alias("n_items"), decontaminate.item_digest(f.item_ids).alias("items_sha256"), (f.n_hit > 0).alias("contaminated"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train_markov(secrets.labelled_samples(docs)))
    s = F.col("secrets")
    n = {k: spans.count_of(s, k) for k in secrets.KINDS}
    base = F.filter(s, lambda x: x["kind"] != "markov")
    return found.select("doc_id", n["assign"].alias("n_assign"), n["access"].alias("n_access"), n["hex"].alias("n_hex"), sha(spans.written(base)).alias("base_sha256"), spans.written(s).alias("spans"))


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = encoders.WordEncoder.opened(tokenizer_path("word_bpe_49k.json"))
    coded = bpe_chunks.encode_chunked(table(spark, sf_dir, "documents"), encoder)
    return coded.select("doc_id", "n_tokens", sha(F.col("ids")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = encoders.ByteEncoder.opened(tokenizer_path("byte_bpe_50k.json"))
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), token_files.token_folder(spark), encoder, 2, encoder.vocabulary)
    return token_files.read_token_files(files)


def op6_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    read = avi.read_media(avi.store_media(docs))
    clips, data, media = F.col("clips"), F.col("payload"), F.col("media")
    longest = F.array_max(F.transform(clips, lambda c: c["last_frame"] - c["first_frame"] + 1))
    level = F.aggregate(clips, F.lit(0.0), lambda a, c: a + c["level"] * (c["last_frame"] - c["first_frame"] + 1)) / (F.element_at(clips, -1)["last_frame"] + 1)
    cuts = F.array_join(F.transform(F.slice(clips, 2, F.greatest(F.size(clips), F.lit(1))), lambda c: c["first_frame"].cast("string")), ",")
    feature = F.concat(F.lit("clips="), F.size(clips), F.lit(";longest="), longest, F.lit(";level="), F.format_number(level, 3), F.lit(";cuts="), cuts)
    return read.select("doc_id", "n_bytes", F.octet_length(data).cast("long").alias("payload_bytes"), sha(data).alias("payload_sha256"), F.crc32(F.substring(data, -64, 64)).alias("tail_crc32"), F.octet_length(media).cast("long").alias("media_bytes"), sha(media).alias("media_sha256"), feature.alias("feature"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return done.select("doc_id", "n_lines", "n_dropped", sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op8_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return cross_entropy.score(docs, cross_entropy.train(docs, target))


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal.find_personal(docs, personal.train_candidates(spark))
    s = F.col("personal")
    base = F.filter(s, lambda x: x["order"] < len(personal.KINDS))
    return found.select("doc_id", *(spans.count_of(s, k).alias(f"n_{k}") for k in personal.KINDS), sha(spans.written(base)).alias("base_sha256"), spans.written(s).alias("spans"))


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.link_near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, threshold=0.8)


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
seen AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, seen.m, item_id FROM seen JOIN win ON seen.k = win.k AND seen.m = win.m),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
k AS (SELECT doc_id, i, line, {_FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM x),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE last IS NOT NULL AND last <> k.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR last = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN often ON k.key = often.key GROUP BY k.doc_id
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM s JOIN f USING (g)),
p AS (SELECT o.doc_id, g, n FROM o JOIN n USING (doc_id) WHERE k <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
x AS (SELECT c.a, c.b, na, nb, count(*) AS inter FROM c JOIN s u ON u.doc_id = c.a JOIN s v ON v.doc_id = c.b AND v.g = u.g GROUP BY ALL),
e AS (SELECT a, b FROM x WHERE 100 * inter >= 80 * (na + nb - inter)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS other FROM e2 UNION SELECT r.doc_id, e2.b FROM r JOIN e2 ON r.other = e2.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, m.c) AS component_id, d.doc_id = least(d.doc_id, m.c) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op7_line_dedup": OP7_SQL, "op10_chosen_path": OP10_SQL}
