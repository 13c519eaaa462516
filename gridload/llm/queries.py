"""One registered query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridload.llm import (
    chat,
    decontaminate,
    language,
    licences,
    lines,
    merkle,
    metric_join,
    mixing,
    neighbours,
    repair,
    secrets,
    simhash,
    toxicity,
)
from gridload.llm.common import held_out
from gridload.session import configure

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op5_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
    items AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
    windows AS (
        SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
        FROM items, generate_series(1, len(ws) - n + 1) AS s(i)),
    grams AS (
        SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
        FROM d, (SELECT DISTINCT n FROM windows), generate_series(1, len(ws) - n + 1) AS s(i)),
    hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
    places AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, generate_series(0, 9) AS s(k) WHERE k < n GROUP BY doc_id),
    found AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    leaks = F.col("leaks")
    return found.select(
        "doc_id",
        leaks["n_words"].alias("n_words"),
        leaks["n_hit"].alias("n_hit"),
        F.size(leaks["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(leaks["items"], ","), 256).alias("items_sha256"),
        (leaks["n_hit"] > 0).alias("contaminated"),
    )


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.as_hex(F.col("fp")[0]).alias("fingerprint"), "component_id", "copies")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_SQL_PATTERNS = (
    (0, rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    (1, "AKIA[A-Z0-9]{12,}", 0),
    (2, "[0-9a-f]{32,}", 0),
    (3, "[A-Za-z0-9+/_-]{20,}", 0),
)
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, source, {kind} AS kind, regexp_extract_all(t, '{p}', 0) AS whole,
        regexp_extract_all(t, '{p}', {group}) AS val, string_split_regex(t, '{p}') AS gaps
        FROM d WHERE regexp_matches(t, '{p}')"""
    for kind, p, group in _SQL_PATTERNS
)
_OP1_SQL = f"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    m AS ({_MATCHES}),
    placed AS (
        SELECT doc_id, source, kind, val[i] AS value, length(whole[i]) AS n,
               CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
        FROM m, generate_series(1, len(whole)) AS g(i)),
    base AS (SELECT * FROM placed WHERE kind IN (1, 2) OR (kind = 0 AND length(value) >= 8)),
    mixed AS (
        SELECT * FROM placed p WHERE kind = 3 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
        AND regexp_matches(value, '[0-9]') AND NOT EXISTS (
            SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.a < p.a + p.n AND p.a < b.a + b.n)),
    found AS (SELECT * FROM base UNION ALL SELECT * FROM mixed),
    judged AS (
        SELECT f.*, owners <= 1 AS live, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || a || ':' || (a + n) AS s
        FROM found f JOIN (SELECT value, count(DISTINCT source) AS owners FROM found GROUP BY value) o USING (value)),
    kept AS (SELECT * FROM judged WHERE kind < 3 OR live),
    each AS (
        SELECT doc_id, count_if(kind = 0) AS n0, count_if(kind = 1) AS n1, count_if(kind = 2) AS n2,
               string_agg(s, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS b, string_agg(s, ',' ORDER BY a, kind) AS e,
               count_if(live) AS n_live, count_if(NOT live) AS n_copied
        FROM kept GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access,
           CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(e, '') AS spans,
           CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
    FROM documents LEFT JOIN each USING (doc_id)
    """


@query("op1_secrets", _OP1_SQL)
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source is an owner, its documents in one language are a repository
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    base, every = F.col("base"), F.col("findings")
    live = F.filter(every, lambda s: s["live"])
    return found.select(
        "doc_id",
        *[secrets.count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(every).alias("spans"),
        F.size(live).cast("bigint").alias("n_live"),
        (F.size(every) - F.size(live)).cast("bigint").alias("n_copied"),
    )


@query(
    "op6_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    windows AS (
        SELECT doc_id, i, trim(l[i], ' ') || chr(10) || trim(l[i + 1], ' ') || chr(10) || trim(l[i + 2], ' ') AS w
        FROM lines, generate_series(1, len(l) - 2) AS g(i) WHERE len(l) >= 3),
    ranked AS (
        SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth
        FROM windows WHERE NOT regexp_full_match(w, '\\s*')),
    covered AS (
        SELECT DISTINCT doc_id, i + k AS pos FROM ranked, generate_series(0, 2) AS g(k) WHERE nth > 1),
    kept AS (
        SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
        FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM lines)
        ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines,
           CAST(coalesce(len(l) - coalesce(k.n, 0), 0) AS BIGINT) AS n_removed,
           CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
    FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint"))
    return lines.remove_repeated_lines(docs).select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("bigint").alias("n_lines"),
        F.col("lines_removed").cast("bigint").alias("n_removed"),
        F.md5("text").alias("text_md5"),
    )


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.learn(docs))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


_OP7_TEXT = r"\### Assistant: </turn> ok"


@query(
    "op7_chat",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    sized AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
               count(*) OVER (PARTITION BY conv_id) AS n,
               length(role) + 2 * length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) + 14
               AS chars FROM turns),
    summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY nth) AS upto FROM sized)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR nth = n), 0) AS BIGINT) AS formatted_chars
    FROM summed GROUP BY conv_id
    """,
)
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = turns.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_OP7_TEXT).alias("text"),
    )
    read = chat.read_back(chat.format_examples(turns.unionByName(added)))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("losses", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query(
    "op9_mixing",
    """
    WITH RECURSIVE counts AS (
        SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
    shares AS (
        SELECT s, greatest(1, CAST(floor(1000 * power(n, 0.5e0) / sum(power(n, 0.5e0)) OVER () + 0.5e0) AS BIGINT)) AS k
        FROM counts),
    lists AS (SELECT list(s ORDER BY s) AS names, list(k ORDER BY s) AS ks, CAST(sum(k) AS BIGINT) AS len FROM shares),
    steps AS (
        SELECT CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(ks, lambda k: CAST(0 AS BIGINT)) AS done
        FROM lists
        UNION ALL
        SELECT t + 1, pick_now,
               list_transform(done, lambda d, i: CASE WHEN i = pick_now THEN d + 1 ELSE d END)
        FROM (
            SELECT t, done, list_sort(list_filter(list_transform(ks, lambda k, i: CASE
                       WHEN done[i] < k AND (done[i] * len) // k <= t
                       THEN [((done[i] + 1) * len + k - 1) // k, i] END), lambda x: x IS NOT NULL))[1][2] AS pick_now
            FROM steps, lists WHERE t < len)),
    cycle AS (
        SELECT names[pick] AS s, done[pick] - 1 AS nth, t - 1 AS slot FROM steps, lists WHERE t > 0),
    numbered AS (
        SELECT doc_id, coalesce(source, '') AS s,
               row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r
        FROM documents)
    SELECT doc_id, n.s AS source, (r // 8) // k * len + c.slot AS slot, r // 8 + 1 AS block,
           ((r // 8) * len) // k AS release, ((r // 8 + 1) * len + k - 1) // k AS deadline, r % 8 AS place
    FROM numbered n JOIN shares USING (s), lists, cycle c WHERE c.s = n.s AND c.nth = (r // 8) % k
    """,
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return found.withColumn("source", mixing.source_key("source"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score = F.col("toxicity.score")
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("toxicity.spans").alias("n_spans"),
    )


@query("op3_neighbours")
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(neighbours.build_index(rows), rows.filter("vec_id % 100 = 0"))


_LICENCE_WORDS = r"regexp_extract_all(lower({}), '[\pL\pN]+(?:\.[0-9]+)*')"
_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(licences.TEMPLATES))


@query(
    "op10_licences",
    f"""
    WITH t AS (SELECT k, name, {_LICENCE_WORDS.format("text")} AS ws FROM (VALUES {_TEMPLATE_ROWS}) v(k, name, text)),
    tw AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(ws) AS w FROM t) GROUP BY k, w),
    vocabulary AS (SELECT DISTINCT w FROM tw),
    p AS (
        SELECT doc_id, source || '/' || lang || '/' || (doc_id // 100) AS dir, coalesce(text, '') AS text,
               array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)),
                   lambda x: regexp_matches(x, '{licences.MARKS}')), chr(10)) AS passage FROM documents),
    pp AS (
        SELECT *, {_LICENCE_WORDS.format("passage")} AS ws, length(passage) >= 0.1e0 * length(text) AS is_file
        FROM p WHERE len({_LICENCE_WORDS.format("passage")}) > 0),
    total AS (SELECT count(*) AS n FROM pp),
    pw AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM pp) GROUP BY doc_id, w),
    df AS (SELECT w, count(*) AS d FROM pw JOIN vocabulary USING (w) GROUP BY w),
    idf AS (SELECT w, ln((1 + n) / (1 + coalesce(d, 0))) + 1 AS i FROM vocabulary LEFT JOIN df USING (w), total),
    tv AS (SELECT k, w, (1 + ln(c)) * i AS v FROM tw JOIN idf USING (w)),
    tn AS (SELECT k, sqrt(sum(v * v)) AS size FROM tv GROUP BY k),
    pv AS (SELECT doc_id, w, (1 + ln(c)) * coalesce(i, ln(1 + n) + 1) AS v FROM pw LEFT JOIN idf USING (w), total),
    pn AS (SELECT doc_id, sqrt(sum(v * v)) AS size FROM pv GROUP BY doc_id),
    cosines AS (
        SELECT pv.doc_id, tv.k, sum(pv.v * tv.v) / any_value(pn.size) / any_value(tn.size) AS c
        FROM pv JOIN tv USING (w) JOIN pn ON pn.doc_id = pv.doc_id JOIN tn ON tn.k = tv.k GROUP BY pv.doc_id, tv.k),
    best AS (
        SELECT doc_id, name, c FROM cosines JOIN t USING (k)
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 12) DESC, k) = 1),
    judged AS (
        SELECT p.doc_id, p.dir, b.name, least(coalesce(b.c, 0), 1) AS cosine, coalesce(b.c, 0) >= 0.6e0 AS own,
               coalesce(pp.is_file, false) AS is_file
        FROM p LEFT JOIN best b USING (doc_id) LEFT JOIN pp USING (doc_id)),
    files AS (SELECT dir, name, count(*) AS n FROM judged WHERE own AND is_file GROUP BY dir, name),
    of_dir AS (
        SELECT dir AS from_dir, name FROM files QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, name DESC) = 1),
    above AS (
        SELECT DISTINCT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS from_dir
        FROM judged, generate_series(0, 3) AS s(depth) WHERE NOT own),
    near AS (
        SELECT dir, from_dir, name FROM above JOIN of_dir USING (from_dir)
        QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
    SELECT doc_id, j.dir, CASE WHEN own THEN j.name ELSE coalesce(near.name, 'none') END AS licence,
           CASE WHEN own THEN 'own' WHEN near.name IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
           round(CAST(cosine AS DOUBLE), 6) AS cosine, CASE WHEN own THEN j.dir ELSE near.from_dir END AS from_dir
    FROM judged j LEFT JOIN near ON near.dir = j.dir
    """,
)
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no paths: source, language and a shelf of 100 ids are the directories
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    path = F.concat_ws("/", "source", "lang", F.expr("doc_id div 100"), "doc_id")
    return licences.scan(docs, path, file_share=0.1).withColumn("cosine", F.round("cosine", 6))


def _told(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
        lambda a, b: list_reduce(range(0, 8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
        xor(a, b)), 4294967295), 4294967295)"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEVEL = "sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16"
_SIBLINGS = """coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS lft,
        coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS rgt"""


@query(
    "op13_merkle",
    f"""
    WITH RECURSIVE texts AS (
        SELECT *, {_LOWERED} AS lowered, {_CRC} % 5 = 0 AS tampered,
               CASE WHEN source IS NULL THEN '-' ELSE ':' || source END AS tree FROM documents),
    leaves AS (SELECT doc_id, tree, {_leaf_sql("text")} AS leaf, {_leaf_sql("lowered")} AS other, tampered FROM texts),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY tree) AS n FROM leaves),
    nodes AS (
        SELECT tree, 0 AS l, i, leaf AS d, n FROM numbered
        UNION ALL SELECT tree, l + 1, i // 16, {_LEVEL} FROM nodes WHERE n > 1 GROUP BY tree, l, i // 16, n),
    subroots AS (
        SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops AS (
        SELECT 0 AS l, i, d, n FROM subroots
        UNION ALL SELECT l + 1, i // 16, {_LEVEL} FROM tops WHERE n > 1 GROUP BY l, i // 16, n),
    sides AS (
        SELECT a.tree, a.l, a.i, {_SIBLINGS} FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.l = b.l
        AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.tree, a.l, a.i),
    top_sides AS (
        SELECT a.l, a.i, {_SIBLINGS} FROM tops a JOIN tops b ON a.l = b.l AND a.i // 16 = b.i // 16
        WHERE a.n > 1 GROUP BY a.l, a.i),
    climbed AS (
        SELECT doc_id, tree, 0 AS l, i, i AS at, n, CASE WHEN tampered THEN other ELSE leaf END AS d, '' AS proof FROM numbered
        UNION ALL SELECT c.doc_id, c.tree, c.l + 1, c.i // 16, c.at, (c.n + 15) // 16, sha256(lft || c.d || rgt), proof || lft || rgt
        FROM climbed c JOIN sides s ON s.tree = c.tree AND s.l = c.l AND s.i = c.i),
    ended AS (
        SELECT c.doc_id, c.tree, c.at, 0 AS l, s.i, s.n, c.d, c.proof FROM climbed c JOIN subroots s USING (tree) WHERE c.n = 1
        UNION ALL SELECT c.doc_id, c.tree, c.at, c.l + 1, c.i // 16, (c.n + 15) // 16, sha256(lft || c.d || rgt), proof || lft || rgt
        FROM ended c JOIN top_sides s ON s.l = c.l AND s.i = c.i)
    SELECT m.doc_id, m.leaf, s.d AS subroot, r.d AS root, sha256(e.proof) AS proof_sha256, e.d AS folded_root,
           e.d = r.d AS verified
    FROM numbered m JOIN ended e ON e.tree = m.tree AND e.at = m.i AND e.n = 1
    JOIN subroots s ON s.tree = m.tree, (SELECT d FROM tops WHERE n = 1) r
    """,
)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(tampered, lowered).otherwise(F.col("text"))
    found = merkle.manifest(docs, changed={"text": text})
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op12_repair")
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    spaced = repair.spaced(turns, "conv_id", "turn", "role", "text")
    edits, counts = repair.repair(repair.damage(spaced, repair.damage_key(spaced)))
    every = turns.select("conv_id").distinct().withColumn("group", repair.group_of("conv_id"))
    found = every.join(counts, "group", "left").join(repair.told(edits), "group", "left")
    zero = F.lit(0).cast("bigint")
    return found.select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op11_jaccard")
def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
