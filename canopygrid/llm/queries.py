"""The numbered queries: each maps a given table to an operator and its result back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopygrid.llm import (bpe, chat, fingerprints, language, nearest, neardup, packing, private, shortest, templates,
                            tokenfiles, turns, whiten)
from canopygrid.session import cut_lineage, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pieces = packing.pieces_of(docs, WORDS, name="doc_id", doc="text").select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(cut_lineage(pieces), order=("doc_id", "piece"))


@query
def op5_bpe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    done = bpe.encode_docs(docs, RANKS, public_tokenizers.PATTERN, name="doc_id", doc="text", decoded="back")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("back", 256).alias("decoded_sha256"))


@query
def op6_token_files(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(table(spark, d, "documents"), path, WORDS, end_id=1, name="doc_id", doc="text")
    stored = tokenfiles.summaries(tokenfiles.read_tokens(spark, path), "doc_id")
    return tokenfiles.with_starts(stored, "doc_id").select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_chat(spark: SparkSession, d: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chats(turns)
    read = F.transform(chat.read_turns("formatted"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = done.select("conv_id", "valid", "formatted", read.alias("back"), chat.loss_text("segments").alias("loss"))
    return back.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(F.array_join("back", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op8_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn(
        "held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    learned = language.learn(docs.where(~F.coalesce("held_out", F.lit(True))))
    done = language.languages(docs.select(F.struct("doc_id", "held_out").alias("name"), "text"), learned, doc="text")
    return done.select("name.doc_id", F.coalesce("name.held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query
def op10_private(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = private.train(private.labelled_windows(docs, name="doc_id", doc="text"))
    done = private.private_spans(docs, model, name="doc_id", doc="text")
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(  # noqa: E731
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")  # noqa: E731
    return done.select("doc_id", *map(count, private.KINDS), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


@query
def op3_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = fingerprints.with_next(table(spark, d, "documents"), name="doc_id", doc="text")
    rows = rows.withColumn("doc", F.coalesce("doc", F.lit(""))).withColumn("next_doc", fingerprints.ahead("doc"))
    n = F.length("doc")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("doc", F.lit(1), n - half), F.substring("next_doc", F.lit(1), half))
    rows = rows.select("bucket", "guest", "key", "tie", n.cast("long").alias("n_chars"),
                       F.when(~F.col("guest"), edited).alias("edited"), fingerprints.winnow("doc").alias("prints"))
    rows = rows.withColumn("own", F.array_distinct("prints.hash"))
    rows = rows.withColumn("next_own", fingerprints.ahead("own")).where(~F.col("guest"))
    rows = fingerprints.fingerprint_docs(rows.withColumnRenamed("prints", "base"), doc="edited")
    return rows.select(
        F.col("key").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.digest("base").alias("fingerprint"), fingerprints.digest("prints").alias("edited_fingerprint"),
        fingerprints.likeness("own", F.array_distinct("prints.hash")).alias("near_edited"),
        fingerprints.likeness("own", "next_own").alias("near_next"))


@query
def op7_templates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return templates.drop_templates(docs, name="doc_id", doc="text", dropped="lines_dropped")


ORACLES["op7_templates"] = templates.SQL


@query
def op4_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents"), name="doc_id", doc="text")


@query
def op2_nearest(spark: SparkSession, d: str) -> DataFrame:
    chips = table(spark, d, "embeddings").withColumnsRenamed({"vec_id": "chip", "embedding": "v"})
    done = nearest.nearest_chips(chips, chips.where(F.col("chip") % 100 == 0))
    return done.select(F.col("query").alias("query_id"), "rank", F.col("chip").alias("vec_id"), "score")


@query
def op11_shortest_pack(spark: SparkSession, d: str) -> DataFrame:
    pieces = shortest.cfg_pieces(table(spark, d, "documents"), WORDS, name="doc_id", doc="text")
    packed = shortest.pack_cfgs(cut_lineage(pieces), name="doc_id")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    done, fit = whiten.whiten_chips(table(spark, d, "embeddings"), "vec_id", "embedding")
    if fit is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    shares = F.array(*[F.lit(float(x)) for x in fit.explained]).cast("array<double>")
    long = done.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return long.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(fit.rows).cast("long").alias("n"), "deviation",
                       "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(fit.identity_error).alias("identity_error"))


@query
def op13_structure_repair(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "conversations")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    draw = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    kept = raw.select("conv_id", "turn", draw.alias("draw"), text("role").alias("role"), text("text").alias("text")).where(F.col("draw") != 0)
    damaged = kept.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("draw") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
    done = turns.repair_turns(damaged)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = (done.report.withColumn("sha256", F.lit(None).cast("string"))
             .unionByName(turns.digests(done.turns), allowMissingColumns=True)
             .unionByName(raw.select("conv_id").distinct(), allowMissingColumns=True))
    return every.groupBy("conv_id").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha256"), F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _edit(prefix: str, cost: str, letter: str) -> str:
    """A prefix (six digits of cost, then letters) with one more edit; null stays null."""
    return f"(lpad(CAST(CAST({prefix}[1:6] AS INT)+{cost} AS VARCHAR),6,'0')||{prefix}[7:]||'{letter}')"


def _structure_sql() -> str:
    """Least (cost, letters) per role state, row after row: marks stand for insertions between rows."""
    extra = "(CASE WHEN x[1]=upper(x[1]) THEN 5 ELSE 0 END)"
    best = [f"a[{i}]" for i in range(1, 5)]
    to_user = [best[0], best[1], best[3]]
    insert_user = f"[a[1],a[2],least(a[3],{','.join(_edit(q, '5', 'I') for q in to_user)}),a[4]]"
    insert_assistant = f"[a[1],a[2],a[3],least(a[4],{_edit('a[3]', '5', 'I')})]"
    keep = lambda role, q: f"CASE WHEN lower(x[1])='{role}' THEN {_edit(q, extra, 'K')} END"  # noqa: E731
    rerole = lambda q: f"CASE WHEN x[1]<>'-' THEN {_edit(q, f'1+{extra}', 'R')} END"  # noqa: E731
    user = ",".join([_edit("a[3]", "2", "D"), *(keep("u", q) for q in to_user), *(rerole(q) for q in to_user)])
    row = (f"[{_edit('a[1]', '2', 'D')},least({_edit('a[2]', '2', 'D')},{keep('s', 'a[1]')}),least({user}),"
           f"least({_edit('a[4]', '2', 'D')},{keep('a', 'a[3]')},{rerole('a[3]')})]")
    return rf"""WITH src AS (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR),' ')||':'||coalesce(CAST(turn AS VARCHAR),' ') AS k FROM conversations),
 drawn AS (SELECT *, xor(list_reduce(flatten(list_transform(range(1,length(k)+1), lambda i: [CAST(ord(k[i]) AS BIGINT),-1,-1,-1,-1,-1,-1,-1,-1])),
  lambda a, x: CASE WHEN x>=0 THEN xor(a,x) ELSE xor(a>>1, 3988292384*(a&1)) END, CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS draw FROM src),
 damaged AS (SELECT conv_id, turn, CASE WHEN draw=4 THEN 'user' ELSE role END AS role,
  CASE WHEN draw=1 THEN '' WHEN draw=2 THEN regexp_replace(text,'[.!?]','','g') ELSE text END AS text,
  unnest(range(CASE WHEN draw=3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw<>0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)||':'||role||text)) AS i FROM damaged),
 judged AS (SELECT *, CASE WHEN NOT regexp_matches(text,'[^ 	-]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i)>1 THEN 'duplicate'
  WHEN NOT regexp_matches(text,'[.!?][ 	-]*\z') THEN 'truncated' ELSE 'none' END AS fault,
  CASE WHEN role[1] IN ('s','u','a') THEN role[1] ELSE 'x' END AS c FROM placed),
 coded AS (SELECT *, CASE fault WHEN 'none' THEN c WHEN 'truncated' THEN upper(c) ELSE '-' END AS code,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i)||c NOT IN ('su','ua','au') AS bad FROM judged),
 convs AS (SELECT conv_id, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn),0) AS gaps, count(*) FILTER (WHERE fault='blank') AS blank,
  count(*) FILTER (WHERE fault='duplicate') AS duplicate, count(*) FILTER (WHERE fault='truncated') AS truncated, count(*) FILTER (WHERE bad) AS illegal,
  flatten(list(['>','<',code] ORDER BY i)) || ['>','<'] AS marks FROM coded GROUP BY conv_id),
 solved AS (SELECT * EXCLUDE (marks), list_reduce(list_transform(marks, lambda m: [m]), lambda a, x: CASE x[1]
  WHEN '>' THEN {insert_user} WHEN '<' THEN {insert_assistant} ELSE {row} END, ['000000',NULL,NULL,NULL]) AS a FROM convs),
 done AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, CAST(least(a[1],a[4])[1:6] AS BIGINT) AS cost, least(a[1],a[4])[7:] AS audit FROM solved),
 letters AS (SELECT conv_id, audit, unnest(range(1,length(audit)+1)) AS p FROM done),
 edits AS (SELECT conv_id, p, audit[p] AS letter, count(*) FILTER (WHERE audit[p]<>'I') OVER w AS i, count(*) FILTER (WHERE audit[p]<>'D') OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
 outs AS (SELECT e.conv_id, p, place, letter, r.role, CASE WHEN letter='I' THEN '' ELSE r.text END AS text,
  bool_or(place=1 AND letter='K' AND lower(r.code)='s') OVER (PARTITION BY e.conv_id) AS has_s
  FROM edits e JOIN coded r ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i=greatest(e.i,1) WHERE letter<>'D'),
 said AS (SELECT conv_id, sha256(string_agg((CASE WHEN letter='K' THEN role WHEN (place-CAST(has_s AS INT))%2=1 THEN 'user' ELSE 'assistant' END)||':'||text,
  chr(10) ORDER BY p)) AS repaired_sha256 FROM outs GROUP BY conv_id)
 SELECT o.conv_id, coalesce(gaps,0) AS gaps, coalesce(blank,0) AS blank, coalesce(duplicate,0) AS duplicate, coalesce(truncated,0) AS truncated,
  coalesce(illegal,0) AS illegal, coalesce(cost,0) AS cost, coalesce(audit,'') AS audit, coalesce(repaired_sha256,sha256('')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id
 LEFT JOIN said ON o.conv_id IS NOT DISTINCT FROM said.conv_id"""


ORACLES["op13_structure_repair"] = _structure_sql()
