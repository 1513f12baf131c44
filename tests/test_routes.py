"""Every route in one run, the vector retriever inside answers, and research with follow-ups."""

from pyspark.sql import functions as F

from tidemark.functions.embedding import hash_embedding
from tidemark.functions.fixed import Tunables
from tidemark.operators import answers
from tidemark.plans import questions as q
from tidemark.plans import routes
from tidemark.session import cut_lineage

TEXTS = {
    "big": {
        "c1": ("d1", "warm", "The refund window lasts 30 days after purchase."),
        "c2": ("d1", "warm", "A receipt is needed for every refund claim."),
        "c3": ("d2", "cold", "Parental leave lasts sixteen weeks for employees."),
        "c4": ("d3", "warm", "Holiday calendars are published every spring by the office."),
        "c5": ("d4", "warm", "The uptime guarantee covers Pro customers with credits."),
    },
    "small": {"s1": ("e1", "warm", "Bicycles are parked behind the main gate.")},
}


def base_of(spark, **more):
    rows = [(kb, c, *v) for kb, held in TEXTS.items() for c, v in held.items()]
    df = spark.createDataFrame(rows, "kb_id string, chunk_id string, doc_id string, tier string, text string")
    none = F.array().cast("array<string>")
    chunks = cut_lineage(df.select(
        "kb_id", "chunk_id", "doc_id", F.lit(0).alias("ord"), F.lit("active").alias("status"), F.lit("").alias("title"), F.lit("").alias("section_path"),
        F.lit("").alias("context"), none.alias("aliases"), none.alias("flags"), "text", (F.col("tier") != "cold").alias("allowed"), F.lit(True).alias("escalated"),
        F.when(F.col("kb_id") == "big", 1_000_000).otherwise(10).alias("token_count"),
    ))
    docs = df.select("kb_id", "doc_id", "tier").distinct().select(
        "kb_id", "doc_id", F.lit("active").alias("status"), "tier", F.lit(1.0).alias("authority"), F.lit(0.7).alias("quality"), F.lit(0.5).alias("freshness"))
    return q.Base.build(chunks, cut_lineage(docs), **more)


def asked_of(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, kb_id string, query string, allow_escalation boolean, allow_general boolean")


def test_every_route_is_met_and_joined(spark, monkeypatch):
    """Which questions go which way and what becomes of them; the routes' own work is stood in for."""
    met = {}

    def stand_in(name, calls):
        def run(asked, *_):
            rows = asked.select("query_id", "query").collect()
            met[name] = {r.query_id for r in rows}
            state = {r.query_id: "failed" if "submarines" in r["query"] and name != "deep" else "verified" for r in rows}
            composed = [(i, s, name, ["open"] if s == "failed" else [], 1.0, 0.0, 1.0, 1.0, 1, 1.0) for i, s in state.items()]
            kinds = "query_id int, status string, answer string, unanswered array<string>, groundedness double, contradiction double, coverage double, citation_accuracy double, claims int, confidence double"
            return routes._Done(
                spark.createDataFrame(composed, kinds),
                spark.createDataFrame([(i, name) for i in state], "query_id int, text string"),
                spark.createDataFrame([(i, 0, name, s != "failed") for i, s in state.items()], "query_id int, subq int, question string, answered boolean"),
                spark.createDataFrame([(i, calls) for i in state], "query_id int, calls long"),
            )

        return run

    def search(asked, base, rounds, cfg, budget, max_parts=None):
        return stand_in("fast", 4)(asked) if max_parts == 1 else stand_in("standard", 7)(asked)

    def research(asked, *_):
        workers = asked.select("query_id", F.lit(0).alias("worker"), F.lit("w").alias("question"), F.lit("verified").alias("status"), F.lit(False).alias("follow_up"))
        return stand_in("deep", 20)(asked), workers

    monkeypatch.setattr(routes, "searched", search)
    monkeypatch.setattr(routes, "read_whole", stand_in("long_context", 3))
    monkeypatch.setattr(routes, "research", research)
    unknown = "How do submarines float and how do volcanoes erupt?"
    asked = asked_of(
        spark,
        (1, "big", "thanks!", True, False),
        (2, "big", "How long is the refund window?", True, False),
        (3, "big", "Compare the refund window and the receipts.", True, False),
        (4, "small", "Where are bicycles parked?", True, False),
        (5, "big", "Research the refund window", True, False),
        (6, "big", unknown, True, False),  # fails the standard way, then is researched
        (7, "big", unknown, False, True),  # may not escalate
        (8, "nowhere", "How long is the refund window?", True, False),
    )
    out = routes.answer_routed(asked, base_of(spark))
    assert met == {"fast": {2, 8}, "standard": {3, 6, 7}, "long_context": {4}, "deep": {5, 6}}
    got = {r.query_id: (r.route, r.status, r.escalated, r.general, r.answer, r.calls) for r in out.answers.collect()}
    assert got == {
        1: ("direct", "direct", False, False, None, 0),
        2: ("fast", "verified", False, False, "fast", 4),
        3: ("standard", "verified", False, False, "standard", 7),
        4: ("long_context", "verified", False, False, "long_context", 3),
        5: ("deep", "verified", False, False, "deep", 20),
        6: ("deep", "verified", True, False, "deep", 27),
        7: ("standard", "failed", False, True, "standard", 7),
        8: ("fast", "verified", False, False, "fast", 4),
    }
    assert {(r.query_id, r.text) for r in out.sentences.collect()} == {(i, v[4]) for i, v in got.items() if i != 1}


def test_a_small_base_is_read_whole(spark):
    asked = asked_of(spark, (4, "small", "Where are bicycles parked?", True, False), (9, "small", "How do submarines float?", True, False))
    routed = {r.query_id: r.route for r in routes.routes(asked, base_of(spark)).collect()}
    assert routed == {4: "long_context", 9: "long_context"}
    budget = spark.createDataFrame([(4, 30), (9, 3)], "query_id int, calls long")
    done = routes.read_whole(asked, base_of(spark), Tunables(standard_heal_rounds=1), budget)
    got = {r.query_id: (r.status, r.answer) for r in done.composed.collect()}
    assert got[4] == ("verified", TEXTS["small"]["s1"][2]) and got[9][0] != "verified"
    assert {r.query_id: r.calls for r in done.spent.collect()} == {4: 3, 9: 3}


def test_research_asks_on_and_keeps_its_calls(spark):
    asked = asked_of(spark, (1, "big", "Research everything", True, False), (2, "big", "Research everything", True, False))
    plan = spark.createDataFrame(
        [(i, 0, "How long is the refund window; how do submarines float?") for i in (1, 2)] + [(i, 1, "What covers the uptime guarantee?") for i in (1, 2)],
        "query_id int, subq int, question string",
    )
    budget = spark.createDataFrame([(1, 120), (2, 14)], "query_id int, calls long")
    done, workers = routes.research(asked, base_of(spark), Tunables(standard_heal_rounds=1), budget=budget, plan=plan)
    told = {(r.query_id, r.worker): (r.question, r.status, r.follow_up) for r in workers.collect()}
    assert told[1, 0][1:] == ("partial", False) and told[1, 1][1:] == ("verified", False)
    assert told[1, 2] == ("how do submarines float?", "failed", True)
    assert not any(i == 2 and told[i, w][2] for i, w in told)  # too few calls are left
    spent = {r.query_id: r.calls for r in done.spent.collect()}
    assert 12 < spent[1] <= 120 and spent[2] <= 14
    answer = {r.query_id: r.answer for r in done.composed.collect()}[1]
    assert "30 days" in answer and "credits" in answer


def test_vectors_find_what_words_do_not(spark):
    def embed(rows):
        return hash_embedding(rows, F.col("text"), 256, "vector").withColumn("model", F.lit("m"))

    base = base_of(spark)
    asked = asked_of(spark, (1, "big", "refundable purchasing", True, False))
    planned = answers.plan_questions(asked.select("kb_id", "query_id", "query")).drop("query")
    by_words = {r.chunk_id for r in q.retrieve(planned, base, k=3).collect()}
    base.vectors = cut_lineage(embed(base.chunks.where("kb_id = 'big'").select("chunk_id", "text")).select("chunk_id", "model", "vector"))
    base.embed = embed
    made = q.question_vectors(planned.withColumn("variants", F.array(F.lit("refund"))), embed)
    assert {(r.subq, r.variant, len(r.vector)) for r in made.collect()} == {(0, 0, 256), (0, 1, 256)}
    both = q.retrieve(planned, base, k=3).collect()
    near = {r.chunk_id for r in both if r.retriever == "dense"}
    assert "c1" in near and "c1" not in by_words and "c3" not in near  # a cold document is not seen by the first pass
    graded, _ = q.first_pass(planned, base)
    assert "c1" in {r.chunk_id for r in graded.collect()}
