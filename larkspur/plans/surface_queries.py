"""Queries over sources, stores, backends and agent loops with deterministic backends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from larkspur.frames import scratch_path
from larkspur.functions import html as H, text as X, vectors as V
from larkspur.functions.backends import embed
from larkspur.operators import graph as G
from larkspur.operators.answer import generate_grounded, rerank_listwise
from larkspur.operators.chunking import chunk_documents
from larkspur.operators.dense import SemanticRouter
from larkspur.operators.entity import accepted
from larkspur.operators.multivector import index_pages, pooled
from larkspur.plans import agents as A
from larkspur.plans.catalogue import SQL, query, values
from larkspur.plans.retrieval_queries import DOCS_SQL, FOLD, HEADS_SQL, RANKED_SQL, _passages, _resolved, _retriever, _words_sql, asked_of, bm25_sql, fuse_sql
from larkspur.plans.suite import body_and_title, chunk_sweep
from larkspur.plans.text_queries import ADAPTIVE_SQL, CLASSED_SQL, INLINE, RISK_SQL, Q, _any_sql, _redacted_sql
from larkspur.registry import backends
from larkspur.schema import CHUNK, with_context
from larkspur.sources.cache import SemanticCache
from larkspur.sources.readers import corpus_jsonl, count_lines, files, golden_jsonl, parse_with, table
from larkspur.sources.stores import create_store, upsert


def _last_line(prompt: str | None) -> str:
    lines = (prompt or "").strip().splitlines()
    return lines[-1].strip() if lines else ""


def _outline(system: pd.Series, prompt: pd.Series) -> pd.Series:
    """Two numbered lines about the prompt's last line."""
    return prompt.map(lambda p: f"1. about {_last_line(p)}\n- details of {_last_line(p)}")


backends.register("generation", "outline", _outline)
backends.register("generation", "supporter", lambda system, prompt: prompt.map(lambda p: "supported"))
backends.register("generation", "closing", lambda system, prompt: prompt.map(lambda p: "Done."))
backends.register("page", "bands", lambda images: images.map(lambda v: [list(v[i : i + 16]) for i in range(0, 64, 16)]))

#: The last line of a text, as backends see it.
LAST = "trim(regexp_extract(trim({0}, ' ' || chr(10)), '[^\\n]*$'))"
LAST_TEXT = LAST.format("text")


# Sources


@query(f"SELECT doc_id::VARCHAR AS id, md5(regexp_extract(text, '^[^\\n]*')) AS title, md5(text) AS digest FROM documents")
def corpus_jsonl_scan(spark, sf_dir):
    """Documents written as JSON lines and read as a corpus."""
    path = scratch_path(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    docs.select(F.col("doc_id").cast("string").alias("id"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), "text").write.json(path)
    return corpus_jsonl(spark, path).select("id", F.md5("title").alias("title"), F.md5("text").alias("digest"))


@query("SELECT md5(text) AS digest, item_id::VARCHAR || ',' || (item_id + 1)::VARCHAR AS relevant, CASE WHEN item_id % 2 = 0 THEN 2.0::DOUBLE END AS gain FROM benchmark WHERE text IS NOT NULL")
def golden_jsonl_scan(spark, sf_dir):
    """Queries with judgments, some graded and some repeated, written as JSON lines and read as a golden set."""
    path = scratch_path(spark, "golden")
    b = table(spark, sf_dir, "benchmark")
    one, two = F.col("item_id").cast("string"), (F.col("item_id") + 1).cast("string")
    b.select(F.col("text").alias("query"), F.array(one, two, one).alias("relevant"), F.when(F.col("item_id") % 2 == 0, F.create_map(one, F.lit(2.0))).alias("gains")).write.json(path)
    g = golden_jsonl(spark, path)
    return g.select(F.md5("query").alias("digest"), F.array_join("relevant", ",").alias("relevant"), F.get(F.map_values("gains"), F.lit(0)).alias("gain"))


STRIPPED_SQL = r"""s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)</(p|div|h[1-6]|li|tr|br\s*/?)>', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM {0}),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM s),
stripped AS (SELECT page_id, trim(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS t FROM u)"""


@query(f"WITH {STRIPPED_SQL.format('pages')} SELECT page_id, 'text/html' AS content_type, md5(t) AS digest FROM stripped WHERE t IS NOT NULL")
def whole_files(spark, sf_dir):
    """Pages written as a file each and read as whole files."""
    path = scratch_path(spark, "files")
    pages = table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.col("html").alias("value"))
    pages.repartition("page_id").write.partitionBy("page_id").text(path)
    f = files(spark, path)
    return f.select(F.regexp_extract("path", r"page_id=(-?\d+)", 1).cast("long").alias("page_id"), "content_type", F.md5("text").alias("digest"))


@query(f"""WITH {values([i for i in INLINE if not i[1].lower().startswith('  <') and not i[1].startswith('<')], 'page_id, html')}, {STRIPPED_SQL.format('pages')}
SELECT page_id, md5(t) AS digest FROM stripped UNION ALL SELECT page_id, md5(CASE WHEN ends_with(lower(html), '.html') THEN regexp_replace(html, '<[^>]+>', '', 'g') ELSE trim(html) END) FROM v""")
def parsed_inline(spark, sf_dir):
    """Inline sources parsed by what they look like."""
    rows = [i for i in INLINE if not i[1].lower().startswith("  <") and not i[1].startswith("<")]
    a = table(spark, sf_dir, "pages").select("page_id", "html").union(spark.createDataFrame(rows, "page_id long, html string"))
    return a.select("page_id", F.md5(H.parse(F.col("html"))).alias("digest"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE NULL END AS text FROM pages")
def parser_registered(spark, sf_dir):
    """A parser registered for one content type fills in its texts."""
    backends.register("parser", "application/pdf", lambda content: content.map(lambda c: bytes(c)[5:].decode()))
    pages = table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 2 == 0, "application/pdf").otherwise("application/zip")
    rows = pages.select("page_id", F.concat(F.lit("%PDF-"), F.coalesce("url", F.lit(""))).cast("binary").alias("content"), kind.alias("content_type"), F.lit(None).cast("string").alias("text"), F.col("url").isNull().alias("none"))
    return parse_with(rows, "application/pdf").select("page_id", F.when(~F.col("none"), F.col("text")).alias("text"))


@query("SELECT doc_id::VARCHAR AS id, md5(CASE WHEN n_chars > 1000 THEN 'new ' || source ELSE lang END) AS digest, (CASE WHEN n_chars > 1000 THEN 2 ELSE 1 END)::BIGINT AS dims FROM documents WHERE n_chars > 1000 OR lang <> 'es'")
def store_upsert(spark, sf_dir):
    """A chunk store is created twice, filled, and written to again; chunks without vectors are left out."""
    path = scratch_path(spark, "store")
    docs = table(spark, sf_dir, "documents")

    def chunks(rows, text, vector):
        made = {"id": F.col("doc_id").cast("string"), "text": text, "embedding": vector, "doc_id": F.col("doc_id").cast("string")}
        return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK.fields])

    create_store(spark, path)
    create_store(spark, path)
    first = upsert(spark, path, 0, chunks(docs, F.col("lang"), F.when(F.col("lang") != "es", F.array(F.lit(1.0)))))
    second = upsert(spark, path, first, chunks(docs.filter("n_chars > 1000"), F.concat(F.lit("new "), F.col("source")), F.array(F.lit(1.0), F.lit(2.0))))
    return spark.read.parquet(f"{path}/v{second}").select("id", F.md5("text").alias("digest"), F.size("quantized").cast("long").alias("dims"))


@query("SELECT (SELECT count(*) FROM documents)::BIGINT AS n_corpus, (SELECT count(*) FROM benchmark)::BIGINT AS n_golden")
def sample_data_check(spark, sf_dir):
    """Lines that aren't blank in two folders of JSON lines."""
    one, two = scratch_path(spark, "check-corpus"), scratch_path(spark, "check-golden")
    table(spark, sf_dir, "documents").select("doc_id").write.json(one)
    table(spark, sf_dir, "benchmark").select("item_id").write.json(two)
    n = [count_lines(spark, [p]).agg(F.sum("n").alias(name)) for p, name in ((one, "n_corpus"), (two, "n_golden"))]
    return n[0].crossJoin(n[1])  # a row each


@query("SELECT doc_id, md5('From ' || source || chr(10) || chr(10) || text) AS digest, md5(text) AS original, 2::BIGINT AS n_tags FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def context_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null and source is not null")
    tags = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("original_text"), F.lit("older"))
    text, tags = with_context(F.col("text"), tags, F.concat(F.lit("From "), F.col("source")))
    return docs.select("doc_id", F.md5(text).alias("digest"), F.md5(tags["original_text"]).alias("original"), F.size(tags).cast("long").alias("n_tags"))


DASHED = [(-1, 0, "- one\n * two *\n\n--\nthree -"), (-2, 0, " - \n*"), (-3, 0, "")]


@query(f"""WITH {values(DASHED, 'conv_id, turn, text')}, a AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, text FROM v),
l AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' -*' || chr(9))), lambda x: x <> '') AS l FROM a)
SELECT conv_id, turn, md5(array_to_string(CASE WHEN len(l) > 0 THEN l ELSE [text] END, '|')) AS digest FROM l""")
def follow_up_lines(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text").union(spark.createDataFrame(DASHED, "conv_id long, turn long, text string"))
    return c.select("conv_id", "turn", F.md5(F.array_join(X.dashed_lines(F.col("text"), F.col("text")), "|")).alias("digest"))


# Vectors and caches


@query("SELECT item_id, true AS same, (trim(text) <> '')::INT::DOUBLE AS length FROM benchmark WHERE text IS NOT NULL")
def instruction_prefix(spark, sf_dir):
    """An instruction goes before queries, not before documents; vectors have length 1."""
    b = table(spark, sf_dir, "benchmark").filter("text is not null")
    told = b.select("item_id", embed(F.col("text"), kind="query", instruction="find this: ").alias("q"), embed(F.concat(F.lit("find this: "), F.col("text"))).alias("d"), embed(F.col("text"), instruction="find this: ").alias("plain"), embed(F.col("text")).alias("p"))
    return told.select("item_id", ((F.col("q") == F.col("d")) & (F.col("plain") == F.col("p"))).alias("same"), F.round(V.norm(F.col("p")), 6).alias("length"))


@query("SELECT item_id AS query_id, 'route-' || item_id % 5 AS label FROM benchmark WHERE text IS NOT NULL")
def router_by_utterances(spark, sf_dir):
    """A router filled with utterances in two steps finds each one's label again, whatever its signs."""
    b = table(spark, sf_dir, "benchmark").filter("text is not null")
    rows = b.select(F.col("item_id").alias("utt_id"), F.col("text").alias("utterance"), F.concat(F.lit("route-"), (F.col("item_id") % 5).cast("string")).alias("label"))
    router = SemanticRouter().add(rows.filter("utt_id % 2 = 0")).add(rows.filter("utt_id % 2 = 1"))
    return router.route(b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("- "), "text", F.lit(" !?")).alias("query")))


@query("SELECT item_id AS query_id, item_id AS entry_id, 1.0::DOUBLE AS similarity, 'answer ' || item_id AS response FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT -1, NULL, NULL, NULL")
def cache_put_get(spark, sf_dir):
    """What two puts have stored is found by the same words between other signs; an unknown query finds nothing."""
    cache = SemanticCache(spark, scratch_path(spark, "cache"))
    b = table(spark, sf_dir, "benchmark").filter("text is not null")
    entries = b.select(F.col("item_id").alias("entry_id"), F.col("text").alias("query"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("response"))
    cache.put(entries.filter("entry_id % 2 = 0"))
    cache.put(entries.filter("entry_id % 2 = 1"))
    asked = b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("- "), "text", F.lit(" !?")).alias("query")).union(spark.createDataFrame([(-1, "zzqx")], "query_id long, query string"))
    return cache.get(asked)


@query("""WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id AS doc_id, 1::BIGINT AS n, round((e[1] + e[17] + e[33] + e[49]) / 4, 6)::DOUBLE AS first, round((e[16] + e[32] + e[48] + e[64]) / 4, 6)::DOUBLE AS last FROM a""")
def pooled_pages(spark, sf_dir):
    """Pages encoded to four patches, pooled to one."""
    pages = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("image"))
    p = index_pages(pages, "bands").withColumn("pooled", pooled(F.col("patches"), 4))
    one = F.get("pooled", F.lit(0))
    return p.select("doc_id", F.size("pooled").cast("long").alias("n"), F.round(F.get(one, F.lit(0)), 6).alias("first"), F.round(F.get(one, F.lit(15)), 6).alias("last"))


# Entities and graphs

RESOLVED_SQL = """
a AS (SELECT lower(n_name) AS key, 'N' || n_nationkey AS id, n_nationkey AS ord FROM nation),
m AS (SELECT n_nationkey::BIGINT AS mention_id, lower(n_name) AS key FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name) || 's' FROM nation UNION ALL SELECT n_nationkey + 200, trim(lower(substr(n_name, 1, 4))) FROM nation),
d AS (SELECT mention_id, id, key FROM m JOIN a USING (key)),
c AS (SELECT mention_id, a.id, a.key AS alias, a.ord, m.key FROM m JOIN a ON starts_with(string_split(a.key, ' ')[1], string_split(m.key, ' ')[1]) AND (starts_with(a.key, m.key) OR starts_with(m.key, a.key)) WHERE mention_id NOT IN (SELECT mention_id FROM d)),
s AS (SELECT *, round(greatest(2.0::DOUBLE * least(length(key), length(alias)) / (length(key) + length(alias)),
  2.0::DOUBLE * least(length(replace(key, ' ', '')), length(replace(alias, ' ', ''))) / (length(replace(key, ' ', '')) + length(replace(alias, ' ', '')))), 9) AS score FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, ord) AS k FROM s),
resolved AS (SELECT mention_id, id AS canonical_id, 'deterministic' AS method, 1.0::DOUBLE AS score, key AS matched_alias FROM d
  UNION ALL SELECT m.mention_id, CASE WHEN score >= 0.6 THEN id END, CASE WHEN score >= 0.85 THEN 'fuzzy' WHEN score >= 0.6 THEN 'review' ELSE 'none' END, coalesce(score, 0.0)::DOUBLE, CASE WHEN score >= 0.6 THEN alias END
  FROM m LEFT JOIN b ON b.mention_id = m.mention_id AND k = 1 WHERE m.mention_id NOT IN (SELECT mention_id FROM d))"""


# Mentions that are names, begin names or go on from them: here the ratio is that of lengths, which SQL can tell.
SQL["crosswalk_fuzzy"] = f"WITH {RESOLVED_SQL} SELECT mention_id, canonical_id, method, score, matched_alias FROM resolved"
SQL["er_accuracy"] = f"""WITH {RESOLVED_SQL}, t AS (SELECT CASE WHEN method IN ('deterministic', 'fuzzy') THEN canonical_id END AS found, 'N' || mention_id % 100 AS expected FROM resolved)
SELECT count(*)::BIGINT AS n, avg((found IS NOT DISTINCT FROM expected)::INT::DOUBLE) AS accuracy, count(*) FILTER (found IS NOT NULL AND found <> expected)::BIGINT AS false_merges FROM t"""


@query(f"WITH {RESOLVED_SQL} SELECT mention_id, CASE WHEN method IN ('deterministic', 'fuzzy') THEN canonical_id END AS canonical_id FROM resolved")
def crosswalk_accepted(spark, sf_dir):
    return accepted(_resolved(spark, sf_dir))


@query("""WITH l AS (SELECT r_regionkey, n_name, r_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) - 1 AS place FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT (r_regionkey * 1000000 + place)::BIGINT AS ord, n_name AS subject, 'lies in' AS relation, r_name AS object FROM l""")
def graph_build(spark, sf_dir):
    """A graph from replies with a triple per line."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("long").alias("ord"), F.concat(F.lit("- "), "n_name", F.lit(" | lies  in | "), "r_name").alias("line"))
    replies = lines.groupBy("ord").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("reply"))
    return G.parse_edges(replies.select("ord", F.col("reply")))


@query("""WITH e AS (SELECT n_nationkey AS ord, '- ' || n_name || ' | in | ' || r_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT md5(string_agg(line, chr(10) ORDER BY ord)) AS digest FROM e""")
def graph_facts(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    triples = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("subject"), F.lit("in").alias("relation"), F.col("r_name").alias("object"))
    return G.facts(G.edges_from_triples(triples)).select(F.md5("facts").alias("digest"))


# Query transforms and answers


@query(f"SELECT item_id AS query_id, {LAST.format('text')} AS query FROM benchmark WHERE text IS NOT NULL")
def hyde_passage(spark, sf_dir):
    return A.hyde(asked_of(spark, sf_dir).filter("query is not null"))


@query(f"SELECT item_id AS query_id, {LAST.format('text')} AS query FROM benchmark WHERE text IS NOT NULL")
def step_back_question(spark, sf_dir):
    return A.step_back(asked_of(spark, sf_dir).filter("query is not null"))


OUTLINE_SQL = f"SELECT item_id AS query_id, 0 AS part, 'about ' || {LAST.format('text')} AS query FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT item_id, 1, 'details of ' || {LAST.format('text')} FROM benchmark WHERE text IS NOT NULL"


@query(f"SELECT item_id AS query_id, 0 AS variant, text AS query FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT query_id, part + 1, query FROM ({OUTLINE_SQL})")
def multi_query_variants(spark, sf_dir):
    return A.multi_query(asked_of(spark, sf_dir).filter("query is not null"), 4, "outline")


@query(f"SELECT query_id, part, query FROM ({OUTLINE_SQL})")
def decomposed_questions(spark, sf_dir):
    return A.decompose(asked_of(spark, sf_dir).filter("query is not null"), "outline")


@query(f"""WITH {RANKED_SQL}, o AS (SELECT query_id, doc_id, rank, count(*) OVER (PARTITION BY query_id) AS n FROM p)
SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE rank WHEN 3 THEN -2 WHEN 1 THEN -1 ELSE rank END))::INTEGER AS rank FROM o QUALIFY rank IS NOT NULL""")
def rerank_by_list(spark, sf_dir):
    p = _passages(spark, sf_dir)
    replies = p.select("query_id").distinct().withColumn("reply", F.lit("[3] > [1] > [99]"))
    return rerank_listwise(p, replies)


@query(f"SELECT item_id AS query_id, {LAST.format(chr(39) + 'Question: ' + chr(39) + ' || text')} AS text, '' AS cited, false AS abstained FROM benchmark WHERE text IS NOT NULL")
def grounded_generation(spark, sf_dir):
    """The offline backend repeats the prompt's last line, the question."""
    p = _passages(spark, sf_dir, 3).withColumn("position", F.col("rank") - 1)
    out = generate_grounded(p, asked_of(spark, sf_dir).filter("query is not null"))
    return out.select("query_id", F.trim("text").alias("text"), F.array_join(F.transform("citations", lambda c: c.cast("string")), ",").alias("cited"), "abstained")


def _with_passages(spark, sf_dir, k=3):
    q = asked_of(spark, sf_dir).filter("query is not null")
    found = _passages(spark, sf_dir, k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda p: p["text"]).alias("passages"))
    return q.join(found, "query_id", "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))


TOP3_SQL = f"{bm25_sql('r', DOCS_SQL, 3)}, n AS (SELECT item_id AS query_id, text AS q, (SELECT count(*) FROM r WHERE r.query_id = item_id) AS n FROM benchmark WHERE text IS NOT NULL)"


@query(f"WITH {TOP3_SQL} SELECT query_id, CASE WHEN n = 0 THEN 'incorrect' ELSE 'ambiguous' END AS grade, (CASE WHEN n = 0 THEN n ELSE 2 * n END)::BIGINT AS n_passages FROM n")
def corrective_retrieval(spark, sf_dir):
    """Doubtful passages get those of another search added."""
    out = A.corrective(_with_passages(spark, sf_dir), _retriever(spark, sf_dir))
    return out.select("query_id", "grade", F.size("passages").cast("long").alias("n_passages"))


@query(f"WITH {TOP3_SQL} SELECT query_id, {LAST.format(chr(39) + 'Question: ' + chr(39) + ' || q')} AS answer, n > 0 AS supported, (n = 0)::INTEGER AS redrafts FROM n")
def self_checked_answers(spark, sf_dir):
    out = A.self_checked(_with_passages(spark, sf_dir), critic="supporter")
    return out.select("query_id", F.trim("answer").alias("answer"), "supported", "redrafts")


@query("SELECT item_id AS query_id, 'Done.' AS answer, 2 AS retrievals FROM benchmark WHERE text IS NOT NULL")
def forward_looking_answers(spark, sf_dir):
    """A sentence that is doubtful each time is looked up each time, and ends the answer when it repeats."""
    return A.forward_looking(asked_of(spark, sf_dir).filter("query is not null"), _retriever(spark, sf_dir), "closing", doubtful=lambda c: F.contains(c, F.lit("Done")))


@query(f"""WITH {bm25_sql('r', DOCS_SQL, 3, f'SELECT query_id * 10 + part AS query_id, query FROM ({OUTLINE_SQL})')}
SELECT item_id AS query_id, 2 AS n_hops, (SELECT count(*) FROM r WHERE r.query_id // 10 = item_id)::INTEGER AS n_evidence FROM benchmark WHERE text IS NOT NULL""")
def self_ask_hops(spark, sf_dir):
    out = A.self_ask(asked_of(spark, sf_dir).filter("query is not null"), _retriever(spark, sf_dir), planner="outline")
    return out.select("query_id", F.size("hops").alias("n_hops"), F.size("evidence").alias("n_evidence"))


LOOPS = rf"({_any_sql('lower(q)', Q.COMPOSITIONAL_CUES)} OR len(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '')) > 18)"


LAST3_SQL = f"{TOP3_SQL}, {bm25_sql('z', DOCS_SQL, 3, f'SELECT item_id AS query_id, {LAST_TEXT} AS query FROM benchmark WHERE text IS NOT NULL')}, l AS (SELECT *, {LOOPS} AS looped, (SELECT count(*) FROM z WHERE z.query_id = n.query_id) AS n_last FROM n)"
LOOP_SQL = f"WITH {LAST3_SQL} SELECT query_id, looped, CASE WHEN looped THEN 'turn_budget' ELSE 'single_shot' END AS terminated, (CASE WHEN looped THEN 3 ELSE 0 END)::INTEGER AS n_hops, (CASE WHEN looped THEN 3 * n_last ELSE n END)::INTEGER AS n_evidence FROM l"


@query(LOOP_SQL)
def interleaved_reasoning(spark, sf_dir):
    """The offline planner asks the query's last line in each hop, until the turns are over."""
    out = A.ircot(asked_of(spark, sf_dir).filter("query is not null"), _retriever(spark, sf_dir))
    return out.select("query_id", "looped", "terminated", F.size("hops").alias("n_hops"), F.size("evidence").alias("n_evidence"))


SQL["agent_loop"] = LOOP_SQL
SQL["adaptive_run"] = f"WITH {TOP3_SQL}, l AS (SELECT query_id, n, {ADAPTIVE_SQL} AS route FROM n) SELECT query_id, route, (CASE WHEN route = 'no_retrieval' THEN 0 ELSE n END)::INTEGER AS n_passages FROM l"


# Suites and chunks

GOLD_SQL = "g AS (SELECT item_id AS query_id, unnest([item_id, item_id + 1, item_id + 7])::VARCHAR AS doc_id FROM benchmark WHERE text IS NOT NULL)"


def card_sql(name: str, ranking: str, k: int) -> str:
    """name, n, ndcg, recall and mrr of a ranking (query_id, doc_id, rank) against ``g``."""
    return f"""SELECT '{name}' AS name, count(*)::BIGINT AS n, round(avg(round(dcg / ideal, 6)), 6)::DOUBLE AS ndcg, round(avg(round(recall, 6)), 6)::DOUBLE AS recall, round(avg(round(rr, 6)), 6)::DOUBLE AS mrr FROM (
  SELECT g.query_id, count(*) FILTER (x.rank <= {k})::DOUBLE / count(*) AS recall, coalesce(1.0 / min(x.rank), 0) AS rr, coalesce(sum(1 / log2(x.rank + 1)) FILTER (x.rank <= {k}), 0) AS dcg,
    list_sum(list_transform(range(1, least({k}, count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ideal
  FROM g LEFT JOIN {ranking} x ON x.query_id = g.query_id AND x.doc_id::VARCHAR = g.doc_id GROUP BY g.query_id)"""


def _gold(spark, sf_dir):
    q = asked_of(spark, sf_dir).filter("query is not null")
    return q.select("query_id", "query", F.array(*[(F.col("query_id") + i).cast("string") for i in (0, 1, 7)]).alias("relevant"), F.lit(None).cast("map<string,double>").alias("gains"))


TEXT_DOCS_SQL = "SELECT doc_id::VARCHAR AS doc_id, text FROM documents"
TEXT_HEADS_SQL = f"SELECT doc_id::VARCHAR AS doc_id, text FROM ({HEADS_SQL})"


@query(f"WITH {GOLD_SQL}, {bm25_sql('body', TEXT_DOCS_SQL, 10)}, {bm25_sql('head', TEXT_HEADS_SQL, 10)}, {fuse_sql(['body', 'head'])}, top AS (SELECT * FROM fused WHERE rank <= 10) {card_sql('body', 'body', 5)} UNION ALL {card_sql('body+title', 'top', 5)}")
def suite_body_title(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    corpus = docs.select(F.col("doc_id").cast("string").alias("id"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), "text")
    return body_and_title(corpus, _gold(spark, sf_dir))


def pack_sql(name: str, target: int, overlap: int) -> str:
    """Common table expressions that end in ``name`` (doc_id, i, text): chunks of documents, one recursion step per chunk."""
    n = name
    return rf"""
{n}_s AS (SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10) || chr(10), chr(1)), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
{n}_a AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x, chr(32) || chr(10) || chr(9))), lambda x: x <> '') AS atoms FROM {n}_s),
{n}_w AS (SELECT doc_id, atoms, len(atoms) AS n, list_transform(atoms, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> ''))) AS w FROM {n}_a),
{n}_p AS (SELECT doc_id, atoms, n, list_transform(range(n + 1), lambda j: coalesce(list_sum(w[1:j]), 0)::BIGINT) AS p FROM {n}_w WHERE n > 0),
{n}_r AS (
  SELECT doc_id, 0 AS i, 0::BIGINT AS b, coalesce(list_filter(range(1, n), lambda j: p[j + 2] > {target})[1], n) AS e FROM {n}_p
  UNION ALL
  SELECT r.doc_id, r.i + 1, nb, coalesce(list_filter(range(r.e + 1, n), lambda j: p[j + 2] - p[nb + 1] > {target})[1], n)
  FROM (SELECT r.*, q.n, q.p, list_filter(range(r.b, r.e + 1), lambda j: q.p[r.e + 1] - q.p[j + 1] <= {overlap})[1] AS nb FROM {n}_r r JOIN {n}_p q USING (doc_id) WHERE r.e < q.n) r),
{n} AS (SELECT doc_id, i, array_to_string(atoms[b + 1:e], ' ') AS text FROM {n}_r JOIN {n}_p USING (doc_id))"""


SQL["chunked_documents"] = f"WITH RECURSIVE {pack_sql('c', 120, 30)} SELECT doc_id || '::' || i AS id, doc_id::VARCHAR AS doc_id, text FROM c"


def _sweep_sql(sizes: tuple[int, ...]) -> str:
    parts = [pack_sql(f"c{s}", s, 0) for s in sizes]
    cards = []
    for s in sizes:
        parts.append(bm25_sql(f"r{s}", f"SELECT doc_id || '::' || i AS doc_id, text FROM c{s}", 20))
        parts.append(f"f{s} AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first)::INTEGER AS rank FROM (SELECT query_id, string_split(doc_id, '::')[1] AS doc_id, min(rank) AS first FROM r{s} GROUP BY ALL))")
        cards.append(card_sql(str(s), f"f{s}", 5))
    return f"WITH RECURSIVE {GOLD_SQL}, {', '.join(parts)} {' UNION ALL '.join(cards)}"


@query(_sweep_sql((40, 120)))
def suite_chunk_sweep(spark, sf_dir):
    return chunk_sweep(table(spark, sf_dir, "documents").filter("text is not null"), _gold(spark, sf_dir), (40, 120))


SQL["rerank_overlap"] = f"""WITH {bm25_sql('r', DOCS_SQL, 20)},
s AS (SELECT query_id, doc_id, {_words_sql('b.text')} AS q, list_distinct(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d USING (doc_id)),
x AS (SELECT query_id, doc_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, w))::DOUBLE / len(q) ELSE 0 END, 9)::DOUBLE AS score FROM s)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x) WHERE rank <= 5"""

SQL["pipeline_answer"] = f"""WITH {bm25_sql('r', DOCS_SQL, 5)}, asked AS (SELECT item_id AS id, text AS q FROM benchmark), {CLASSED_SQL},
f AS (SELECT query_id, doc_id, rank, text, {RISK_SQL} < 0.5 AS good FROM r JOIN documents USING (doc_id)),
k AS (SELECT *, bool_or(good) OVER (PARTITION BY query_id) AS any_good FROM f),
h AS (SELECT query_id, doc_id, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM k WHERE good OR NOT any_good),
source AS (SELECT DISTINCT doc_id, text FROM h), {_redacted_sql('source')},
o AS (SELECT query_id, ({FOLD})::INTEGER AS position, p6.t AS text FROM h JOIN p6 USING (doc_id)),
s AS (SELECT o.*, len(list_intersect({_words_sql('o.text')}, {_words_sql('b.text')})) AS shared FROM o JOIN benchmark b ON b.item_id = o.query_id),
best AS (SELECT * FROM s WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, position) = 1)
SELECT id AS query_id, route AS complexity, CASE WHEN text IS NULL THEN 'I don''t have enough information to answer that.' ELSE text || ' [' || (position + 1) || ']' END AS text, coalesce((position + 1)::VARCHAR, '') AS citations, text IS NULL AS abstained
FROM classed LEFT JOIN best ON query_id = id"""
