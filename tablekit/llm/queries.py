"""The registered queries of the operators: ``QUERIES`` and, where SQL can say
the same, ``ORACLE``. Every query reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def put(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql.strip()
        return fn
    return put


@query("op3_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import duplicate_groups
    return duplicate_groups(documents(spark, sf_dir))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(documents(spark, sf_dir), **byte_bpe_files())


def byte_bpe_files() -> dict:
    """The vocabulary of the packing query, as installed on the cluster."""
    import public_tokenizers as vocabularies
    return {"path": vocabularies.path("byte_bpe_50k.json"),
            "ranks": vocabularies.path("byte_bpe_50k.tiktoken"), "pattern": vocabularies.PATTERN}


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .bpe import encode_decode
    found = encode_decode(documents(spark, sf_dir), vocabularies.path("word_bpe_49k.json"))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups
    return near_groups(documents(spark, sf_dir))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_spans, fit
    docs = documents(spark, sf_dir)
    found = find_spans(docs, fit(docs))
    line = "array_join(transform({}, s -> concat_ws(':', s.kind, string(s.start), string(s.end))), ',')"
    return found.selectExpr(
        "doc_id", *(f"bigint(size(filter(spans, s -> s.base AND s.kind = '{k}'))) AS n_{k}" for k in KINDS),
        f"sha2({line.format('filter(spans, s -> s.base)')}, 256) AS base_sha256", f"{line.format('spans')} AS spans")


@query("op7_langid")
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, identify
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "runs")


REMOVED = "aggregate(spans, bigint(0), (n, s) -> n + s.end - s.start) AS n_removed"


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup
    return substring_dedup(documents(spark, sf_dir)).selectExpr(
        "doc_id", "n_units AS n_words", REMOVED, "sha2(kept, 256) AS kept_sha256")


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup
    return suffix_dedup(documents(spark, sf_dir)).selectExpr(
        "doc_id", "n_units AS n_bytes", REMOVED, "bigint(size(spans)) AS n_spans", "sha2(kept, 256) AS kept_sha256")


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints
    return fingerprints(documents(spark, sf_dir), families=("",)).selectExpr(
        "doc_id", "n_chars", "sha2(edited, 256) AS edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op2_tool_calls", """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, role, text, conv_id || ':' || turn AS call_id FROM conversations WHERE role IN ('system', 'user')
), steps AS (
  SELECT c.conv_id, c.turn, p.turn AS parent FROM calls c
  JOIN calls p ON p.conv_id = c.conv_id AND p.turn IN (c.turn - 1, c.turn - 2) WHERE c.role = 'user'
), chain AS (
  SELECT conv_id, turn, 0 AS level FROM calls
  UNION SELECT s.conv_id, s.turn, k.level + 1 FROM chain k JOIN steps s ON s.conv_id = k.conv_id AND s.parent = k.turn
), levels AS (SELECT conv_id, turn, max(level) AS level FROM chain GROUP BY ALL),
answers AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.turn, c.call_id, if(c.role = 'system', 'configure', 'respond') AS name, l.level::BIGINT AS level,
       if(a.text IS NULL, 'open', 'linked') AS status, ''::VARCHAR AS faults,
       if(c.role = 'system',
          to_json({'after': []::VARCHAR[], 'arguments': {'text': c.text}, 'call_id': c.call_id, 'conv_id': c.conv_id,
                   'level': l.level, 'name': 'configure', 'result': a.text, 'turn': c.turn}),
          to_json({'after': [c.conv_id || ':' || (c.turn - 2), c.conv_id || ':' || (c.turn - 1)],
                   'arguments': {'prompt': c.text, 'turn': c.turn}, 'call_id': c.call_id, 'conv_id': c.conv_id,
                   'level': l.level, 'name': 'respond', 'result': a.text, 'turn': c.turn}))::VARCHAR AS json
FROM calls c JOIN levels l USING (conv_id, turn) LEFT JOIN answers a USING (conv_id, turn)
""")
def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import SCHEMAS, conversation_calls, link_tool_calls
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    found = link_tool_calls(*conversation_calls(turns), SCHEMAS)
    return found.withColumn("faults", F.array_join("faults", ", "))


def leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(
        f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


@query("op11_merkle_manifest", f"""
WITH RECURSIVE base AS (
  SELECT *, {leaf_sql('text')} AS leaf, {leaf_sql("replace(text, chr(10), '')")} AS cut,
         coalesce('1' || source, '0') AS tree,
         -- crc32 of the decimal doc_id, bit by bit
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384)))) % 2 = 0 AS hit
  FROM documents
), leaves AS (
  SELECT doc_id, leaf, if(hit, cut, leaf) AS found, tree, count(*) OVER (PARTITION BY tree) AS n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM base
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1
  GROUP BY tree, level, idx // 3, n
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1
  GROUP BY level, idx // 3, n
), runs AS (
  SELECT tree, level, idx // 3 AS run, list(digest ORDER BY idx) AS own FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT '2', level, idx // 3, list(digest ORDER BY idx) FROM tops WHERE n > 1 GROUP BY ALL
), below AS (
  SELECT doc_id, leaf, tree, 0 AS level, idx, found AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT b.doc_id, b.leaf, b.tree, b.level + 1, b.idx // 3,
         sha256(array_to_string(list_transform(own, lambda d, i: if(i = b.idx % 3 + 1, folded, d)), '')),
         proof || array_to_string(list_filter(own, lambda d, i: i != b.idx % 3 + 1), '')
  FROM below b JOIN runs r ON r.tree = b.tree AND r.level = b.level AND r.run = b.idx // 3
), above AS (
  SELECT b.doc_id, b.leaf, s.digest AS subroot, 0 AS level, s.idx, s.n, folded, proof
  FROM below b JOIN subroots s ON s.tree = b.tree WHERE b.level = (SELECT max(level) FROM nodes x WHERE x.tree = b.tree)
  UNION ALL
  SELECT a.doc_id, a.leaf, a.subroot, a.level + 1, a.idx // 3, (a.n + 2) // 3,
         sha256(array_to_string(list_transform(own, lambda d, i: if(i = a.idx % 3 + 1, folded, d)), '')),
         proof || array_to_string(list_filter(own, lambda d, i: i != a.idx % 3 + 1), '')
  FROM above a JOIN runs r ON r.tree = '2' AND r.level = a.level AND r.run = a.idx // 3
)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM above, (SELECT digest FROM tops WHERE n = 1) t WHERE above.n = 1
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import PROOF_DIGEST, audited
    return audited(documents(spark, sf_dir), PROOF_DIGEST).selectExpr(
        "doc_id", "lower(hex(digest)) AS leaf", "lower(hex(subroot)) AS subroot", "lower(hex(root)) AS root",
        "lower(hex(proof)) AS proof_sha256", "lower(hex(folded)) AS folded_root", "folded = root AS verified")


@query("op12_collocations", """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
found AS (SELECT lang, w[i:i + k - 1] AS p FROM spans, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, p, count(*) AS f FROM found GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.p, c.a, n, k, x.f AS l, y.f AS r,
         ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN sizes s ON s.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT q.lang, q.p[b:e] AS p, f FROM f q, range(1, 6) t(b), range(1, 6) u(e)
  WHERE len(q.p) > 2 AND e <= len(q.p) AND b < e AND e - b + 1 < len(q.p)
), kept AS (
  SELECT w.* FROM weakest w WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.p = w.p AND 100 * i.f >= 100 * w.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations
    return collocations(documents(spark, sf_dir))


@query("op13_secrets")
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import KINDS, find_secrets, fit
    docs = documents(spark, sf_dir)
    found = find_secrets(docs, fit(docs))
    line = "array_join(transform({}, s -> concat_ws(':', s.kind, string(s.start), string(s.end))), ',')"
    return found.selectExpr(
        "doc_id", *(f"bigint(size(filter(spans, s -> s.base AND s.kind = '{k}'))) AS n_{k}" for k in KINDS),
        f"sha2({line.format('filter(spans, s -> s.base)')}, 256) AS base_sha256", f"{line.format('spans')} AS spans")
