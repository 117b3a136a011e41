"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import kneser_ney
from docweave.llm.audit import filter_audit
from docweave.llm.chat import format_turns, read_back
from docweave.llm.common import is_remainder, table
from docweave.llm.decontaminate import contamination
from docweave.llm.embeddings import linked
from docweave.llm.language import fit_profiles, identify_languages
from docweave.llm.licenses import scan_licenses
from docweave.llm.manifest import tampered_leaf, verify
from docweave.llm.mixing import mix, quality_weights
from docweave.llm.packing import packed_digest
from docweave.llm.quality import fit_quality, score_quality
from docweave.llm.simhash import simhash_groups
from docweave.llm.toxicity import fit_examples, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op2_toxicity_neighbours")
def op2_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(~is_remainder("doc_id", 4, 2))
    scored = score_toxicity(docs, fit_examples(docs, learned))
    return scored.withColumn("held_out", is_remainder("doc_id", 4, 2))


@query("op4_quality_ranking")
def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = table(spark, sf_dir, "labels").where(~is_remainder("doc_id", 5, 0))
    return score_quality(docs, fit_quality(docs, learned)).withColumn("held_out", is_remainder("doc_id", 5, 0))


@query("op10_language_profiles")
def op10_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(~is_remainder("doc_id", 3, 1))
    return identify_languages(docs, fit_profiles(learned)).withColumn("held_out", is_remainder("doc_id", 3, 1))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op3_benchmark_decontamination",
    f"""
    WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS g
        FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s
              FROM items WHERE len(w) > 0)),
    docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
    places AS (
        SELECT rid, size, s, array_to_string(w[s:s + size - 1], ' ') AS g
        FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS s
              FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
    hits AS (SELECT rid, s, p.size, item_id FROM places p JOIN windows i ON p.g = i.g AND p.size = i.size),
    covered AS (
        SELECT rid, count(DISTINCT place) AS n_hit
        FROM (SELECT rid, unnest(range(s, s + size)) AS place FROM hits) GROUP BY rid),
    named AS (
        SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
    """,
)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


_PROBE = "</s>[INST] ok [/INST]"


@query(
    "op9_chat_formatting",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
    escaped AS (
        SELECT *, length(role) + length(text)
            + length(role || text) - length(replace(role || text, chr(92), ''))
            + len(regexp_extract_all(role || '|' || text, '</?s>|[[]/?INST[]]')) AS chars
        FROM turns)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars + {len("<s></s>[INST][/INST]")}) AS BIGINT) AS formatted_chars
    FROM escaped GROUP BY conv_id
    """,
)
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], turns.schema)
    return read_back(format_turns(turns.union(probe)))


@query(
    "op7_embedding_near_dedup",
    """
    WITH RECURSIVE
    given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    sound AS (
        SELECT vec_id, v FROM given
        WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
    reach AS (
        SELECT vec_id AS a, vec_id AS b FROM given
        UNION
        SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id,
           vec_id = component_id AS kept
    FROM given JOIN least ON least.a = vec_id
    """,
)
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


@query("op6_kneser_ney")
def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~is_remainder("doc_id", 10, 0)), kneser_ney.ORDER)
    return kneser_ney.score(docs, model).withColumn("held_out", is_remainder("doc_id", 10, 0))


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


_FIELDS = "doc_id source lang n_chars".split()


def _leaf_sql(text: str) -> str:
    fields = [*[(f, f"CAST({f} AS VARCHAR)") for f in _FIELDS], ("text", text)]
    return "sha256(" + " || ".join(
        f"CASE WHEN {f} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END" for f, v in fields
    ) + ")"


# crc32 bit by bit: every byte is followed by eight shifts (-1).
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ord(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


@query(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE
    rows AS (
        SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf_sql("text")} AS leaf,
               CASE WHEN {_CRC32} % 3 = 0
                    THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
        FROM documents),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place,
               count(*) OVER (PARTITION BY lang) AS n
        FROM rows),
    nodes AS (
        SELECT lang, 0 AS level, place, n, leaf AS digest FROM leaves
        UNION ALL
        SELECT lang, any_value(level) + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
        FROM nodes WHERE n > 1 GROUP BY lang, place // 8),
    subroots AS (
        SELECT lang, level AS depth, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
        FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS level, place, n, subroot AS digest FROM subroots
        UNION ALL
        SELECT any_value(level) + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
        FROM tops WHERE n > 1 GROUP BY place // 8),
    way AS (
        SELECT rid, level, l.place // CAST(pow(8, level) AS BIGINT) AS pos, list(x.digest ORDER BY x.place) AS run, any_value(x.place) // 8 * 8 AS first
        FROM leaves l JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.n > 1
            AND x.place // 8 = l.place // CAST(pow(8, level + 1) AS BIGINT)
        GROUP BY ALL
        UNION ALL
        SELECT rid, s.depth + level, s.place // CAST(pow(8, level) AS BIGINT) AS pos, list(x.digest ORDER BY x.place), any_value(x.place) // 8 * 8
        FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
            JOIN tops x ON x.n > 1 AND x.place // 8 = s.place // CAST(pow(8, level + 1) AS BIGINT)
        GROUP BY ALL),
    steps AS (
        SELECT rid, level, array_to_string(run[:pos - first], '') AS head, array_to_string(run[pos - first + 2:], '') AS tail FROM way),
    proofs AS (SELECT rid, string_agg(head || tail, '' ORDER BY level) AS proof, count(*) AS long FROM steps GROUP BY rid),
    folds AS (
        SELECT rid, 0 AS level, coalesce(changed, leaf) AS digest FROM leaves
        UNION ALL
        SELECT f.rid, f.level + 1, sha256(s.head || f.digest || s.tail)
        FROM folds f JOIN steps s ON s.rid = f.rid AND s.level = f.level)
    SELECT doc_id, leaf, subroot, t.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.digest AS folded_root,
           f.digest = t.digest AS verified
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON t.n = 1
        LEFT JOIN proofs p ON p.rid = l.rid JOIN folds f ON f.rid = l.rid AND f.level = coalesce(long, 0)
    """,
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents"), tampered_leaf())


_MD5_TEXT = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END"
    for c, v in (("doc_id", "CAST(doc_id AS VARCHAR)"), ("source", "source"), ("text", "text"))
)


@query(
    "op12_source_mix",
    rf"""
    WITH quality AS (
        SELECT doc_id, pow(4.0, avg(quality) - 0.5) AS weight FROM labels
        WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
    sized AS (
        SELECT row_number() OVER () AS rid, d.doc_id, source, coalesce(weight, 1.0) AS weight,
               CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size,
               CAST('0x' || substr(md5({_MD5_TEXT.replace("doc_id", "d.doc_id")}), 1, 13) AS BIGINT) AS bits
        FROM documents d LEFT JOIN quality q ON q.doc_id = d.doc_id),
    sources AS (
        SELECT source, sum(size) AS s, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
        FROM sized GROUP BY source),
    levels AS (
        SELECT a.source, a.s, a.w, 2 * a.s / a.w AS level,
               (SELECT sum(least(2 * b.s, 2 * a.s / a.w * b.w)) FROM sources b) <= 1.5 * (SELECT sum(s) FROM sources) AS is_full
        FROM sources a),
    targets AS (
        SELECT source, CAST(s AS BIGINT) AS source_size,
               CAST(CASE WHEN is_full THEN 2 * s ELSE w * (1.5 * (SELECT sum(s) FROM sources)
                   - (SELECT coalesce(sum(2 * s), 0) FROM levels WHERE is_full)) / (SELECT sum(w) FROM levels WHERE NOT is_full) END AS DOUBLE) AS target
        FROM levels),
    ordered AS (
        SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
               coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY -ln((bits + 1) / 4503599627370496.0) / weight, doc_id NULLS LAST, bits, rid
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sized z JOIN targets t ON t.source IS NOT DISTINCT FROM z.source)
    SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
               budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
    FROM ordered
    """,
)
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, quality_weights(table(spark, sf_dir, "labels"))).drop("epochs", "part")


@query(
    "op13_filter_audit",
    r"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    counted AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words FROM texts),
    marks AS (
        SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    flags AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
               CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
               || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
               || CASE WHEN 100 * (strlen(text) - strlen(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
               || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
               || CASE WHEN min(c.doc_id) OVER (PARTITION BY text) < c.doc_id THEN 'E' ELSE '' END AS fails
        FROM counted c LEFT JOIN marks m ON m.doc_id = c.doc_id),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
    kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY ALL),
    parts AS (SELECT DISTINCT part FROM kinds),
    effects AS (
        SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, fails, n, good, toxic,
               contains(fails, substr(filter_order, step, 1)) AS failing,
               fails <> '' AND regexp_matches(fails, '[' || substr(filter_order, 1, step) || ']') AS gone,
               step > 1 AND fails <> '' AND regexp_matches(fails, '[' || left(filter_order, step - 1) || '_]') AS before
        FROM parts JOIN kinds USING (part), steps),
    summed AS (
        SELECT part, filter_order, step, f,
               coalesce(sum(n) FILTER (NOT gone), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT before), 0) AS removed,
               coalesce(sum(n) FILTER (failing AND before), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
               coalesce(sum(good) FILTER (failing AND NOT before), 0) AS good_lost,
               coalesce(sum(toxic) FILTER (failing AND NOT before), 0) AS toxic_lost
        FROM effects GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM summed
    """,
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
