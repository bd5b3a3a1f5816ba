"""Source and sink queries: tables are written in a source's layout to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.keys import short_name
from ..operators import quality as q
from ..operators.metrics import METRICS, all_metrics
from ..plans.benchmark import build_items, join_and_verify, keyed_items
from ..session import scratch_path
from ..sources import readers as rd_
from ..sources import writers as wr
from ..streaming.incremental import current_metrics, score_stream
from .registry import COUNTS, VALUES, cte, long_sql, metrics_sql, query, rd, rounded, rounded_metrics

KEYS = ["method", "vlm", "seed"]
LONG = {"P": fx.P_SQL, **metrics_sql(KEYS), "L": long_sql(KEYS, METRICS)}
# folders that Spark writes for partition columns
WRITTEN = r"/{a}=([^/]+)/vlm=([^/]+)/seed=(\d+)/part-[^/]*\.json$"


def _result_tree(spark, d, first):
    wide = all_metrics(fx.predictions(spark, d), KEYS)
    path = scratch_path(spark, "results")
    doc = wide.select(F.col("method").alias(first), "vlm", "seed", F.struct("n_samples", *METRICS).alias("overall"))
    doc.write.partitionBy(first, "vlm", "seed").json(path)
    return path


@query("s01_result_tree", cte(f"select method, vlm, cast(seed as int) as seed, metric, {rd('value')} as value from L", **LONG))
def s01(spark, d):
    return rounded(rd_.read_results(spark, _result_tree(spark, d, "method"), WRITTEN.format(a="method")))


@query(
    "s02_variant_tree",
    cte(f"""select method as variant, vlm, seed, metric, {rd('value')} as value from L union all
select 'full' as variant, vlm, seed, metric, {rd('value')} as value from L""", **LONG),
)
def s02(spark, d):
    path = _result_tree(spark, d, "variant")
    pattern = WRITTEN.format(a="variant")
    nested = rd_.read_results(spark, path, pattern, ("variant", "vlm", "seed"))
    return rounded(nested.unionByName(nested.withColumn("variant", F.lit("full"))))


@query("s03_prediction_records", cte(f"select cast(sample_id as varchar) as sample_id, dataset, {rd('c')} as c, y from P where method <> 'm4'", P=fx.P_SQL))
def s03(spark, d):
    P = fx.predictions(spark, d)
    path = scratch_path(spark, "predictions")
    key = F.col("sample_id").cast("string").alias("sample_id")
    # two field spellings, gzipped lines, and records without a confidence
    P.where("method < 'm2'").select(key, "dataset", F.col("c").alias("confidence_score"), F.col("y").alias("ground_truth_correctness")).write.json(f"{path}/a", compression="gzip")
    P.where("method in ('m2', 'm3')").select(key, "dataset", F.col("c").alias("confidence"), (F.col("y") == 1).alias("label")).write.json(f"{path}/b")
    P.where("method = 'm4'").select(key, "dataset", F.col("y").alias("label")).write.json(f"{path}/c")
    return rounded(rd_.read_predictions(spark, [f"{path}/{x}" for x in "abc"], multiline=False))


@query(
    "s04_sample_arrays",
    f"select cast(vec_id as varchar) as hash_id, cast(64 as int) as n, {rd('list_sum(cast(embedding as double[]))')} as s, cast(label % 2 as int) as label from embeddings where label % 3 <> 0",
)
def s04(spark, d):
    path = scratch_path(spark, "samples")
    fx.table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("hash_id"),
        F.array("embedding", F.transform("embedding", lambda x: -x)).alias("hidden_states"),
        F.when(F.col("label") % 3 != 0, (F.col("label") % 2).cast("int")).alias("is_correct"),
    ).write.parquet(path)
    read = rd_.read_samples(spark.read.parquet(path), "first")
    v = F.col("vector").cast("array<double>")
    return rounded(read.select("hash_id", F.size("vector").alias("n"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"), "label"))


@query("s05_tsv_with_blobs", "select cast(doc_id as varchar) as doc_id, lang, md5(text) as content_md5, base64(encode(text)) = base64(encode(text)) as same from documents")
def s05(spark, d):
    path = scratch_path(spark, "tsv")
    blob = F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "")
    fx.table(spark, d, "documents").select("doc_id", "lang", blob.alias("image")).write.option("sep", "\t").option("header", True).csv(path)
    read = rd_.read_tsv(spark, path, "doc_id string, lang string, image string")
    raw = F.unbase64("image")
    return read.select("doc_id", "lang", F.md5(raw).alias("content_md5"), (F.translate(F.base64(raw), "\r\n", "") == F.col("image")).alias("same"))


@query("s06_json_lines", "select conv_id, turn, role, text from conversations")
def s06(spark, d):
    path = scratch_path(spark, "jsonl")
    fx.table(spark, d, "conversations").write.json(path)
    return rd_.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("s07_split_save", cte("select split, count(*) as n, count(distinct hash_id) as n_keys from I group by split", I=fx.ITEMS_SQL))
def s07(spark, d):
    path = scratch_path(spark, "split")
    wr.write_split(fx.items(spark, d), path, shard_bytes=1 << 20)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("hash_id").alias("n_keys"))


# every fifth row a PNG, GIF, WebP, JPEG, JPEG behind a long comment; every eleventh row is cut off
@query("s08_image_headers", cte("select sample_id, case when sample_id % 11 <> 0 then cast(width as int) end as width, case when sample_id % 11 <> 0 then cast(height as int) end as height, sample_id % 11 <> 0 as ok from Z", Z=fx.SIZES_SQL))
def s08(spark, d):
    def big(c, digits):
        return F.lpad(F.hex(c), digits, "0")

    def little(c, digits):
        return F.array_join(F.reverse(F.regexp_extract_all(big(c, digits), F.lit(".."), F.lit(0))), "")

    w, h, kind = F.col("width"), F.col("height"), F.col("sample_id") % 5
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), little(w, 4), little(h, 4), F.lit("000000"))
    webp = F.concat(F.lit("524946461E000000574542505650385" + "80A00000000000000"), little(w - 1, 6), little(h - 1, 6))
    frame = F.concat(F.lit("FFC0001108"), big(h, 4), big(w, 4), F.lit("03011100021100031100"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), frame)
    # some comments reach past the bytes that are looked at first
    comment = F.when(F.col("sample_id") % 100 == 4, F.repeat(F.lit("FFFEEA62" + "20" * 60000), 2)).otherwise(F.lit("FFFE000820202020" + "2020"))
    late = F.concat(F.lit("FFD8"), comment, frame)
    whole = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, webp).when(kind == 3, jpeg).otherwise(late)
    content = F.unhex(F.when(F.col("sample_id") % 11 != 0, whole).otherwise(F.substring(whole, 1, 12)))
    return rd_.blob_dims(fx.sizes(spark, d).select("sample_id", content.alias("image")), "image").drop("image")


@query(
    "s10_first_paraphrase",
    cte("""select row_idx, case row_idx % 5 when 0 then concat('a ', dataset) when 1 then concat('b ', dataset) when 2 then concat('c ', dataset)
  when 3 then concat('d ', dataset) else case when row_idx % 2 = 0 then concat('e ', dataset) end end as paraphrase from I""", I=fx.ITEMS_SQL),
)
def s10(spark, d):
    items = fx.items(spark, d).select("row_idx", "dataset")
    i, name = F.col("row_idx"), F.col("dataset")

    def listed(letter):
        return F.array(F.concat(F.lit(f"{letter} "), name), F.lit("other"))

    first = items.where(i % 5 == 0).select("row_idx", listed("a").alias("paraphrases"))
    second = items.where((i % 5).isin(0, 1)).select("row_idx", listed("b").alias("paraphrases"))
    value = (
        F.when(i % 5 == 2, F.concat(F.lit("c "), name))
        .when(i % 5 == 3, F.to_json(F.struct(listed("d").alias("paraphrases"))))
        .when((i % 5 == 4) & (i % 2 == 0), F.to_json(listed("e")))
        .otherwise(F.to_json(F.array().cast("array<string>")))
    )
    return rd_.first_paraphrase(items, first, second, items.select("row_idx", value.alias("value")), "row_idx").drop("dataset")


@query(
    "s11_result_sink",
    cte(f"""select n_samples, {rd('auroc')} as auroc, {rd('ece')} as ece, records from met cross join (select count(*) as records from P)""", P=f"select 1 as one, * from ({fx.P_SQL})", **metrics_sql(["one"])),
)
def s11(spark, d):
    path = scratch_path(spark, "sink")
    P = fx.predictions(spark, d).select(F.col("sample_id").cast("string").alias("sample_id"), "dataset", F.col("c").alias("confidence_score"), F.col("y").alias("ground_truth_correctness"))
    wr.write_results(P, all_metrics(fx.predictions(spark, d), []), path, {"model": "org/name"})
    records = rd_.read_predictions(spark, f"{path}/records", multiline=False).agg(F.count("*").alias("n")).scalar()
    read = spark.read.json(f"{path}/summary")
    return rounded(read.select("overall.n_samples", "overall.auroc", "overall.ece").withColumn("records", records))


@query("s12_manifest", cte("""select count(*) as n_samples, min(hash_id) as first_key, max(hash_id) as last_key, '{"split": "all", "version": 2}' as config, '{hash_id}.npz' as key_pattern from I""", I=fx.ITEMS_SQL))
def s12(spark, d):
    return wr.manifest(fx.items(spark, d), "hash_id", {"version": 2, "split": "all"}, "{hash_id}.npz").drop("created")


@query(
    "s13_contract_scan",
    cte("""select 'n_rows' as level, split, '' as model, '' as source, count(*) as expected from I group by split union all
select 'source_unique', split, '', dataset, count(distinct hash_id) from I group by split, dataset""", I=fx.ITEMS_SQL),
)
def s13(spark, d):
    items = fx.items(spark, d)
    # the document is one row: a count per split and per (split, source)
    rows = items.groupBy("split").agg(F.count("*").alias("n"))
    splits = rows.select(F.map_from_entries(F.collect_list(F.struct("split", F.create_map(F.lit("n_rows"), "n")))).alias("m"))
    cells = items.groupBy("split", "dataset").agg(F.countDistinct("hash_id").alias("n"))
    inner = cells.groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("dataset", "n"))).alias("s"))
    sources = inner.select(F.map_from_entries(F.collect_list(F.struct("split", "s"))).alias("m"))
    doc = spark.range(1).select(F.to_json(F.struct(splits.scalar().alias("splits"), sources.scalar().alias("per_source"))).alias("doc"))
    return doc.select(F.inline(q.contract_rows(F.col("doc"))))


@query("st01_incremental_scoring", cte(rounded_metrics(["method", "vlm"]), P=fx.P_SQL, **metrics_sql(["method", "vlm"])))
def st01(spark, d):
    P = fx.predictions(spark, d)
    base = scratch_path(spark, "stream")
    # days arrive as files, each written by all cores, and the first day arrives twice
    for day in (0, 1, 2, 0):
        arrived = P.where(F.col("sample_id") % 3 == day).repartition(spark.sparkContext.defaultParallelism, "sample_id")
        arrived.write.mode("append").parquet(f"{base}/in")
    two_days = max(1, len(spark.read.schema(P.schema).parquet(f"{base}/in").inputFiles()) // 2)
    stream = score_stream(
        spark, f"{base}/in", P.schema, f"{base}/out", f"{base}/checkpoint", ["sample_id", "method", "vlm", "seed"],
        ["method", "vlm"], files_per_batch=two_days,
    )
    stream.awaitTermination()
    return rounded(current_metrics(spark, f"{base}/out", ["method", "vlm"]).select("method", "vlm", *COUNTS, *VALUES))


@query(
    "e02_benchmark_build",
    cte("""select split, count(*) as n, sum(is_correct)::bigint as n_correct from (
  select I.split, cast(length(a.text) % 2 as int) as is_correct from (select distinct on (question) question, split from (
    select *, case split when 'train' then 0 when 'validation' then 1 else 2 end as r from I) order by question, r, row_idx) I
  join (select text from documents) a on a.text = I.question) group by split""", I=fx.ITEMS_SQL),
)
def e02(spark, d):
    raw = fx.items(spark, d).drop("hash_id").withColumns({"answer": F.lit("yes"), "image": F.lit("none"), "dataset": F.lit("doc"), "category": F.lit("all")})
    items = keyed_items(raw, "image")
    built = build_items({s: items.where(F.col("split") == s) for s in ("train", "validation", "test")})
    outputs = items.select("hash_id", F.lit("org/m1").alias("model"), "question").select(
        "hash_id", short_name(F.col("model")).alias("model_name"), F.lit("x").alias("model_response"),
        (F.length("question") % 2).cast("int").alias("is_correct"),
    )
    from ..operators.joins import join_outputs

    expected = q.actual_counts(join_outputs(built, outputs)).withColumnRenamed("actual", "expected")
    stored = join_and_verify(built, outputs, expected, scratch_path(spark, "joined"))
    return stored.groupBy("split").agg(F.count("*").alias("n"), F.sum("is_correct").alias("n_correct"))
