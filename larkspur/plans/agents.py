"""Query transforms and control loops around a generation backend.

Backends see all active queries of a step at once.  Loops run a bounded number of
steps on the driver; each step is one plan over the queries still active, cut in
the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.frames import cut
from larkspur.functions import backends as B
from larkspur.functions.routing import adaptive_route, is_compositional
from larkspur.functions.text import dashed_lines, list_lines, number_passages

#: (query_id, query) -> (query_id, query, text, rank)
Retriever = Callable[[DataFrame], DataFrame]


def _no_passages() -> Column:
    return F.array().cast("array<string>")


def _ask(queries: DataFrame, system: str, provider: str, prompt: Column | None = None) -> DataFrame:
    return queries.withColumn("reply", B.generate(F.lit(system), F.col("query") if prompt is None else prompt, provider))


def hyde(queries: DataFrame, provider: str = "echo") -> DataFrame:
    """query_id, query: a passage that would answer, to be embedded in the query's place."""
    return _ask(queries, "Write a short passage that answers the question.", provider).select("query_id", F.trim("reply").alias("query"))


def step_back(queries: DataFrame, provider: str = "echo") -> DataFrame:
    """query_id, query: a more general question."""
    return _ask(queries, "Ask the more general question behind this one.", provider).select("query_id", F.trim("reply").alias("query"))


def multi_query(queries: DataFrame, n: int = 4, provider: str = "echo") -> DataFrame:
    """query_id, variant, query: the query and rephrasings that differ from it, n in all."""
    if n <= 1:
        return queries.select("query_id", F.lit(0).alias("variant"), "query")
    said = _ask(queries, f"Rephrase the question in {n - 1} ways, one per line.", provider)
    other = F.filter(list_lines(F.col("reply")), lambda v: F.lower(v) != F.lower(F.col("query")))
    return said.select("query_id", F.posexplode(F.slice(F.concat(F.array("query"), other), 1, n)).alias("variant", "query"))


def decompose(queries: DataFrame, provider: str = "echo") -> DataFrame:
    """query_id, part, query: sub-questions, or the query itself."""
    lines = list_lines(F.col("reply"))
    return _ask(queries, "Split the question into sub-questions, one per line.", provider).select("query_id", F.posexplode(F.when(F.size(lines) > 0, lines).otherwise(F.array("query"))).alias("part", "query"))


def _passages(found: DataFrame) -> DataFrame:
    """query_id, passages in rank order."""
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda p: p["text"]).alias("found"))


def _answered(rows: DataFrame, provider: str) -> DataFrame:
    prompt = F.concat(number_passages(F.col("passages")), F.lit("\n\nQuestion: "), F.col("query"))
    return rows.withColumn("answer", B.generate(F.lit("Answer from the passages."), prompt, provider))


def adaptive(queries: DataFrame, retrieve: Retriever, provider: str = "echo", max_steps: int = 3) -> DataFrame:
    """query_id, route, passages, answer.

    Without retrieval, with one pass, or with passes repeated while they bring
    passages that are new; passages that repeat within one pass are kept.
    """
    routed = cut(queries.withColumn("route", adaptive_route(F.col("query"))).withColumn("passages", _no_passages()))
    active = routed.filter("route <> 'no_retrieval'")
    state = routed.filter("route = 'no_retrieval'")
    for step in range(max(1, max_steps)):
        found = _passages(retrieve(active.select("query_id", "query")))
        rows = active.join(found, "query_id", "left")
        new = F.filter(F.coalesce("found", _no_passages()), lambda p: ~F.array_contains(F.col("passages"), p))
        rows = cut(rows.withColumn("new", new).withColumn("passages", F.concat("passages", "new")))
        going = (F.col("route") == "multi") & (F.size("new") > 0) & F.lit(step + 1 < max_steps)
        state = state.unionByName(rows.filter(~going).select(*state.columns))
        active = rows.filter(going).select(*state.columns)
        if active.isEmpty():
            break
    return _answered(state, provider).select("query_id", "route", "passages", "answer")


def grade(queries: DataFrame, provider: str = "echo") -> DataFrame:
    """query_id, grade of (query_id, query, passages): incorrect, ambiguous or correct."""
    said = F.lower("reply")
    label = F.when(F.size("passages") == 0, "incorrect").when(F.contains(said, F.lit("incorrect")), "incorrect").when(F.contains(said, F.lit("ambiguous")), "ambiguous").when(F.contains(said, F.lit("correct")), "correct").otherwise("ambiguous")
    prompt = F.concat(number_passages(F.col("passages")), F.lit("\n\nQuery: "), F.col("query"))
    return _ask(queries, "Grade the passages: correct, ambiguous or incorrect.", provider, prompt).select("query_id", label.alias("grade"))


def corrective(queries: DataFrame, web_search: Retriever | None = None, provider: str = "echo") -> DataFrame:
    """query_id, grade, passages: what a search of the web replaces (incorrect) or adds to (ambiguous)."""
    rows = queries.join(grade(queries, provider), "query_id")
    if web_search is None:
        return rows.select("query_id", "grade", "passages")
    web = _passages(web_search(rows.filter("grade <> 'correct'").select("query_id", "query")))
    more = F.coalesce("found", _no_passages())
    passages = F.when(F.col("grade") == "incorrect", more).when(F.col("grade") == "ambiguous", F.concat("passages", more)).otherwise(F.col("passages"))
    return rows.join(web, "query_id", "left").select("query_id", "grade", passages.alias("passages"))


def self_checked(queries: DataFrame, provider: str = "echo", critic: str = "echo", max_redrafts: int = 1) -> DataFrame:
    """query_id, answer, supported, redrafts of (query_id, query, passages): drafts until a critic finds support."""
    rows = cut(_answered(queries, provider).withColumn("redrafts", F.lit(0)))
    prompt = F.concat(number_passages(F.col("passages")), F.lit("\n\nAnswer: "), F.col("answer"))
    done = None
    for step in range(max_redrafts + 1):
        said = F.lower(B.generate(F.lit("Is the answer supported by the passages? supported or unsupported"), prompt, critic))
        supported = (F.size("passages") > 0) & F.contains(said, F.lit("supported")) & ~F.contains(said, F.lit("unsupported"))
        judged = cut(rows.withColumn("supported", supported))
        last = step == max_redrafts
        out = judged if last else judged.filter("supported")
        done = out if done is None else done.unionByName(out)
        if last:
            break
        rows = cut(_answered(judged.filter("not supported").drop("supported", "answer"), provider).withColumn("redrafts", F.lit(step + 1)).select(*rows.columns))
        if rows.isEmpty():
            break
    return done.select("query_id", "answer", "supported", "redrafts")


def forward_looking(queries: DataFrame, retrieve: Retriever, provider: str = "echo", doubtful: Callable[[Column], Column] | None = None, max_sentences: int = 8) -> DataFrame:
    """query_id, answer, retrievals: sentence by sentence, retrieving for doubtful ones and writing them again."""
    rows = queries.select("query_id", "query", F.lit("").alias("answer"), F.lit(0).alias("retrievals"), _no_passages().alias("passages"))
    done = None
    for _ in range(max_sentences):
        prompt = F.concat(number_passages(F.col("passages")), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nSo far: "), F.col("answer"))
        drafted = cut(_ask(rows, "Write the next sentence, or nothing at the end.", provider, prompt).withColumn("reply", F.trim("reply")))
        if doubtful is not None:
            low = drafted.filter((F.col("reply") != "") & doubtful(F.col("reply")))
            found = _passages(retrieve(low.select("query_id", F.col("reply").alias("query"))))
            again = low.join(found, "query_id", "left").withColumn("passages", F.coalesce("found", _no_passages())).withColumn("retrievals", F.col("retrievals") + 1).drop("found", "reply")
            sure = drafted.join(low.select("query_id"), "query_id", "left_anti")
            drafted = cut(sure.unionByName(_ask(again, "Write the next sentence, or nothing at the end.", provider, prompt).withColumn("reply", F.trim("reply")).select(*sure.columns)))
        ended = (F.col("reply") == "") | F.contains("answer", F.col("reply"))
        out = drafted.filter(ended).drop("reply")
        done = out if done is None else done.unionByName(out)
        rows = cut(drafted.filter(~ended).withColumn("answer", F.trim(F.concat_ws(" ", "answer", "reply"))).drop("reply"))
        if rows.isEmpty():
            break
    return done.unionByName(rows).select("query_id", "answer", "retrievals")


def agentic(queries: DataFrame, retrieve: Retriever, provider: str = "echo", planner: str = "echo", critic: str = "echo", max_hops: int = 3, top_k: int = 3, gate: Callable[[Column], Column] = is_compositional) -> DataFrame:
    """query_id, answer, evidence, hops, looped, terminated.

    Queries that the gate lets pass are asked once; others loop: the next
    sub-query is planned from the evidence, its passages are added as they come,
    and a critic ends the loop with ENOUGH.
    """
    empty_hops = F.array().cast("array<struct<subquery:string,passages:array<string>>>")
    start = queries.select("query_id", "query", _no_passages().alias("passages"), empty_hops.alias("hops"), gate(F.col("query")).alias("looped"))
    start = cut(start)
    single = start.filter("not looped")
    found = _passages(retrieve(single.select("query_id", "query")).filter(F.col("rank") <= top_k))
    single = single.drop("passages").join(found.withColumnRenamed("found", "passages"), "query_id", "left").withColumn("passages", F.coalesce("passages", _no_passages())).withColumn("terminated", F.lit("single_shot"))
    columns = ["query_id", "query", "passages", "hops", "looped", "terminated"]
    done, active = single.select(*columns), start.filter("looped")
    for _ in range(max_hops):
        if active.isEmpty():
            break
        evidence = number_passages(F.col("passages"), "\n", "(none yet)")
        planned = active.withColumn("subquery", F.trim(B.generate(F.lit("Give the next sub-question."), F.concat(F.lit("Evidence:\n"), evidence, F.lit("\n\n"), F.col("query")), planner)))
        planned = cut(planned.withColumn("subquery", F.when(F.col("subquery") == "", F.col("query")).otherwise(F.col("subquery"))))
        found = _passages(retrieve(planned.select("query_id", F.col("subquery").alias("query"))).filter(F.col("rank") <= top_k))
        rows = planned.join(found, "query_id", "left").withColumn("found", F.coalesce("found", _no_passages()))
        rows = rows.withColumn("passages", F.concat("passages", "found")).withColumn("hops", F.concat("hops", F.array(F.struct("subquery", F.col("found").alias("passages")))))
        verdict = B.generate(F.lit("Reply ENOUGH if the evidence suffices, else MORE."), F.concat(number_passages(F.col("passages"), "\n", "(none yet)"), F.lit("\n\n"), F.col("query")), critic)
        rows = cut(rows.withColumn("enough", F.startswith(F.upper(F.trim(verdict)), F.lit("ENOUGH"))).drop("subquery", "found"))
        done = done.unionByName(rows.filter("enough").withColumn("terminated", F.lit("enough")).select(*columns))
        active = rows.filter("not enough").drop("enough")
    done = done.unionByName(active.withColumn("terminated", F.lit("turn_budget")).select(*columns))
    return _answered(done, provider).select("query_id", "answer", F.col("passages").alias("evidence"), "hops", "looped", "terminated")


ircot = agentic


def self_ask(queries: DataFrame, retrieve: Retriever, provider: str = "echo", planner: str = "echo", max_hops: int = 3, top_k: int = 3) -> DataFrame:
    """query_id, answer, evidence, hops: sub-questions are listed once and each is looked up."""
    said = cut(_ask(queries, "List the follow-up questions, one per line.", planner))
    parts = said.select("query_id", F.posexplode(F.slice(dashed_lines(F.col("reply"), F.col("query")), 1, max_hops)).alias("hop", "subquery"))
    keyed = parts.withColumn("part_id", F.concat_ws("#", F.col("query_id").cast("string"), F.col("hop").cast("string")))
    found = _passages(retrieve(keyed.select(F.col("part_id").alias("query_id"), F.col("subquery").alias("query"))).filter(F.col("rank") <= top_k))
    hops = keyed.join(found.withColumnRenamed("query_id", "part_id"), "part_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hop", "subquery", F.coalesce("found", _no_passages()).alias("passages")))).alias("h"))
    rows = queries.join(hops, "query_id").withColumn("passages", F.flatten(F.transform("h", lambda x: x["passages"])))
    return _answered(rows, provider).select("query_id", "answer", F.col("passages").alias("evidence"), F.transform("h", lambda x: F.struct(x["subquery"].alias("subquery"), x["passages"].alias("passages"))).alias("hops"))
