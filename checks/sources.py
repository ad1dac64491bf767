"""Sources, sinks and the checks made on loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.features import FEATURE_SQL, NAMES
from checks.registry import check, table, texts
from checks.splits import RANDOM_SQL
from moltable.operators.features import text_features
from moltable.operators.index import with_global_index
from moltable.operators.prepare import clean_index, keep_labels
from moltable.operators.splits import random_kfold, splits_from_files
from moltable.operators.validate import check_arity, check_task, require_columns, resolve_labels
from moltable.plans.prepare import feature_job
from moltable.runtime import new_path
from moltable.sources.catalog import (
    BENCHMARK_CLASSIFICATION,
    BENCHMARK_REGRESSION,
    TASK_ADAPTATION,
    budget_plan,
    dataset_catalog,
    with_table_counts,
)
from moltable.sources.readers import (
    combine_tables,
    read_csv,
    read_log_lines,
    read_log_whole,
    read_named_split,
    read_normalization,
    read_properties,
    read_split_record,
    read_split_rows,
    read_table,
    split_record_path,
    text_items,
)
from moltable.sources.writers import write_csv, write_logs, write_splits

PART_SQL = "count(*) AS n, sum(p_size)::BIGINT AS sum_size, round(avg(p_retailprice), 6) AS avg_price"


def _part_totals(part, *keys):
    return part.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("p_size").alias("sum_size"),
        F.round(F.avg("p_retailprice"), 6).alias("avg_price"),
    )


def _csv_round_trip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = new_path(spark, "part") + ".csv"
    write_csv(part, path)
    return part, path


@check("src_csv", f"SELECT p_brand, {PART_SQL} FROM part GROUP BY p_brand")
def src_csv(spark, sf_dir):
    part, path = _csv_round_trip(spark, sf_dir)
    return _part_totals(read_csv(spark, path, part.schema), "p_brand")


@check("snk_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def snk_csv(spark, sf_dir):
    part, path = _csv_round_trip(spark, sf_dir)
    return read_csv(spark, path, part.schema)


@check(
    "src_by_ext",
    " UNION ALL ".join(f"SELECT '{f}' AS format, {PART_SQL} FROM part" for f in ("csv", "jsonl", "parquet")),
)
def src_by_ext(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = None
    for suffix in ("csv", "jsonl", "parquet"):
        path = new_path(spark, "part") + f".{suffix}"
        if suffix == "csv":
            write_csv(part, path)
        else:
            part.write.format("json" if suffix == "jsonl" else suffix).save(path)
        one = _part_totals(read_table(spark, path, part.schema)).select(F.lit(suffix).alias("format"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@check(
    "src_named_split",
    """
    SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'labelled' END AS split, lang AS subset,
           count(*) AS n, sum(n_chars)::BIGINT AS sum_chars
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2
    """,
)
def src_named_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("split"))
    path = new_path(spark, "corpus")
    (
        docs.join(labelled, "doc_id", "left")
        .select("doc_id", "n_chars", F.col("lang").alias("subset"), F.coalesce("split", F.lit("unlabelled")).alias("split"))
        .write.partitionBy("split", "subset")
        .parquet(path)
    )
    both = read_named_split(spark, path, "labelled").unionByName(read_named_split(spark, path, "unlabelled"))
    return both.groupBy("split", "subset").agg(F.count("*").alias("n"), F.sum("n_chars").alias("sum_chars"))


PROPERTY_SQL = f"""
    SELECT label_idx, count(*) AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS top
    FROM (SELECT unnest([{", ".join(f"f.{n}::DOUBLE" for n in NAMES)}]) AS x,
                 unnest(range({len(NAMES)}))::INTEGER AS label_idx FROM ({FEATURE_SQL}) f)
    GROUP BY label_idx
"""


def _property_files(spark, sf_dir):
    return feature_job(texts(spark, sf_dir), "text", text_features(F.col("text")), new_path(spark, "features"))


def _property_totals(spark, sf_dir):
    records = read_properties(spark, _property_files(spark, sf_dir)[0])
    cells = records.select(F.posexplode("labels").alias("label_idx", "x"))
    return cells.groupBy("label_idx").agg(
        F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x"), 6).alias("top")
    )


@check("src_mtr_jsonl", PROPERTY_SQL)
def src_mtr_jsonl(spark, sf_dir):
    return _property_totals(spark, sf_dir)


@check(
    "snk_mtr_jsonl",
    f"SELECT length(f.text) AS length, count(*) AS n, round(sum(f.entropy), 6) AS sum_entropy "
    f"FROM ({FEATURE_SQL}) f GROUP BY 1",
)
def snk_mtr_jsonl(spark, sf_dir):
    records = read_properties(spark, _property_files(spark, sf_dir)[0])
    at = NAMES.index("entropy")
    return records.groupBy(F.length("smile").alias("length")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("labels")[at]), 6).alias("sum_entropy")
    )


NORMALIZATION_SQL = " UNION ALL ".join(
    f"SELECT {i} AS label_idx, '{n}' AS label_name, round(avg(f.{n}), 6) AS mean, round(stddev_pop(f.{n}), 6) AS std "
    f"FROM ({FEATURE_SQL}) f"
    for i, n in enumerate(NAMES)
)


def _normalization(spark, sf_dir):
    stats = read_normalization(spark, _property_files(spark, sf_dir)[1])
    return stats.select("label_idx", "label_name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@check("src_norm_json", NORMALIZATION_SQL)
def src_norm_json(spark, sf_dir):
    return _normalization(spark, sf_dir)


@check("snk_norm_json", f"SELECT count(*) AS n_labels, round(sum(mean), 4) AS sum_mean FROM ({NORMALIZATION_SQL})")
def snk_norm_json(spark, sf_dir):
    return _normalization(spark, sf_dir).agg(
        F.count("*").alias("n_labels"), F.round(F.sum("mean"), 4).alias("sum_mean")
    )


@check("feat_job", NORMALIZATION_SQL)
def feat_job(spark, sf_dir):
    return _normalization(spark, sf_dir)


def _split_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "splits")
    write_splits(random_kfold(docs, 3, 7, "doc_id").withColumn("splitter", F.lit("random")), path)
    return read_split_rows(spark, path)


@check(
    "snk_splits_json",
    f"SELECT 'random' AS splitter, fold, split, count(*) AS n, sum(row_idx)::BIGINT AS sum_idx FROM ({RANDOM_SQL}) GROUP BY fold, split",
)
def snk_splits_json(spark, sf_dir):
    rows = _split_files(spark, sf_dir)
    return rows.groupBy("splitter", "fold", "split").agg(F.count("*").alias("n"), F.sum("row_idx").alias("sum_idx"))


@check("src_splits_json", f"SELECT fold, split, pos_in_split, row_idx FROM ({RANDOM_SQL})")
def src_splits_json(spark, sf_dir):
    return _split_files(spark, sf_dir).select("fold", "split", "pos_in_split", "row_idx")


def event_logs(spark, sf_dir):
    """A folder of logs, one per event type, made of all events in order of their ids."""
    events = table(spark, sf_dir, "events")
    line = F.format_string("step %d loss %.4f", "event_id", "value")
    lines = events.select(F.concat("event_type", F.lit(".log")).alias("file"), "event_id", line.alias("value"))
    folder = new_path(spark, "logs")
    # Ranges of (file, step): a long log is several parts in order, not one task.
    ordered = lines.repartitionByRange("file", "event_id").sortWithinPartitions("file", "event_id")
    ordered.select("file", "value").write.partitionBy("file").text(folder)
    return folder


@check(
    "src_log_lines",
    """
    SELECT event_type AS file, count(*) AS n_lines,
           arg_min(printf('step %d loss %.4f', event_id, value), event_id) AS first_line,
           arg_max(printf('step %d loss %.4f', event_id, value), event_id) AS last_line
    FROM events GROUP BY 1
    """,
)
def src_log_lines(spark, sf_dir):
    lines = read_log_lines(spark, event_logs(spark, sf_dir))
    return lines.groupBy("file").agg(
        F.count("*").alias("n_lines"),
        F.min_by("value", "line_at").alias("first_line"),
        F.max_by("value", "line_at").alias("last_line"),
    )


@check("ord_files", "SELECT event_type AS file, row_number() OVER (ORDER BY event_type) - 1 AS place FROM (SELECT DISTINCT event_type FROM events)")
def ord_files(spark, sf_dir):
    files = read_log_lines(spark, event_logs(spark, sf_dir)).select("file").distinct()
    return with_global_index(files, ["file"], "place").select("file", "place")


def page_logs(spark, sf_dir):
    """A folder of logs, one per page."""
    pages = table(spark, sf_dir, "pages")
    folder = new_path(spark, "whole")
    named = pages.select(F.concat(F.lit("page_"), "page_id", F.lit(".log")).alias("file"), F.col("html").alias("value"))
    write_logs(named, folder)
    return folder


@check(
    "src_log_whole",
    "SELECT 'page_' || page_id AS file, length(html) + 1 AS n_chars, md5(lower(html) || chr(10)) AS digest FROM pages",
)
def src_log_whole(spark, sf_dir):
    whole = read_log_whole(spark, page_logs(spark, sf_dir))
    return whole.select("file", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


@check(
    "src_text_pairs",
    """
    SELECT conv_id, turn, 0 AS item, length(text) AS n_chars FROM conversations WHERE length(text) > 0
    UNION ALL SELECT conv_id, turn, 1, length(role) FROM conversations WHERE length(role) > 0
    """,
)
def src_text_pairs(spark, sf_dir):
    items = text_items(table(spark, sf_dir, "conversations"), "text", "role", ["conv_id", "turn"])
    return items.select("conv_id", "turn", "item", F.length("text").alias("n_chars"))


@check(
    "flt_nonempty",
    """
    SELECT lang, count(*) AS n, sum(length(t))::BIGINT AS sum_chars
    FROM (SELECT lang, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE length(t) > 0 GROUP BY lang
    """,
)
def flt_nonempty(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    kept = text_items(lines, "line", keys=["lang"])
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("sum_chars"))


@check(
    "src_combine",
    """
    SELECT 'documents' AS source_table, count(*) AS n, sum(length(text))::BIGINT AS sum_chars, count(lang) AS n_lang FROM documents
    UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT, 0 FROM benchmark
    UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT, 0 FROM conversations
    """,
)
def src_combine(spark, sf_dir):
    texts = {n: table(spark, sf_dir, n) for n in ("documents", "benchmark", "conversations")}
    return (
        combine_tables({n: df.select("text", *[c for c in df.columns if c == "lang"]) for n, df in texts.items()})
        .groupBy("source_table")
        .agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("sum_chars"), F.count("lang").alias("n_lang"))
    )


# Stand-ins for dataset entries: table, text column, label columns, task, number of tasks.
CATALOG = [
    ("documents", "text", "n_chars", "regression", 1),
    ("labels", "doc_id", "quality,toxic", "classification", 2),
    ("embeddings", "vec_id", "embedding", "mtr", 64),
    ("benchmark", "text", "", "mlm", 1),
    ("pages", "html", "", "mlm", 1),
    ("conversations", "text", "", "mlm", 1),
    ("events", "event_type", "value", "regression", 1),
    ("part", "p_name", "p_size,p_retailprice", "regression", 2),
    ("lineitem", "l_returnflag", "l_quantity,l_extendedprice,l_discount,l_tax", "regression", 4),
]
CATALOG_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS name, '{task}' AS task, {k} AS n_tasks, (SELECT count(*) FROM {n}) AS n_rows"
    for n, _, _, task, k in CATALOG
)


def _counted_catalog(spark, sf_dir):
    rows = [(n, text, labels, task, k) for n, text, labels, task, k in CATALOG]
    catalog = spark.createDataFrame(rows, "name string, text_column string, label_columns string, task string, n_tasks int")
    return with_table_counts(catalog, {n: table(spark, sf_dir, n) for n, *_ in CATALOG})


@check("src_catalog", CATALOG_SQL)
def src_catalog(spark, sf_dir):
    return _counted_catalog(spark, sf_dir).select("name", "task", "n_tasks", "n_rows")


# The documents are dealt to the datasets of the shipped catalog, in the order of their names.
SHIPPED = sorted([*BENCHMARK_CLASSIFICATION, *BENCHMARK_REGRESSION, *TASK_ADAPTATION])
SHIPPED_VALUES = ", ".join(
    f"({i}, '{n}', '{'classification' if n in BENCHMARK_CLASSIFICATION else 'regression'}', {BENCHMARK_CLASSIFICATION.get(n, 1)}, "
    f"{'false' if n in BENCHMARK_CLASSIFICATION else 'true'}, '{'task_adaptation' if n in TASK_ADAPTATION else 'benchmark'}')"
    for i, n in enumerate(SHIPPED)
)


@check(
    "src_catalog_shipped",
    f"""
    SELECT name, task, n_tasks, apply_transforms, kind, count(doc_id) AS n_rows, coalesce(sum(length(text)), 0)::BIGINT AS n_chars
    FROM (VALUES {SHIPPED_VALUES}) c (i, name, task, n_tasks, apply_transforms, kind) LEFT JOIN documents ON doc_id % {len(SHIPPED)} = i
    GROUP BY ALL
    """,
)
def src_catalog_shipped(spark, sf_dir):
    """Rows and characters that each dataset of the shipped catalog holds; a dataset without rows stays."""
    names = F.array(*map(F.lit, SHIPPED))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % len(SHIPPED)).cast("int").alias("at"), F.length("text").alias("size"))
    held = docs.groupBy(F.get(names, F.col("at")).alias("name")).agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_chars"))
    catalog = dataset_catalog(spark).select("name", "task", "n_tasks", "apply_transforms", "kind")
    return catalog.join(held, "name", "left").fillna(0, ["n_rows", "n_chars"])


@check(
    "agg_rowcount_plan",
    f"""
    SELECT name, n_rows, round(0.00003 * sqrt(32 / 1024.0), 12) AS scaled_lr,
           round(0.05 * sqrt(32.0 / (n_rows * 10)), 9) AS weight_decay FROM ({CATALOG_SQL})
    """,
)
def agg_rowcount_plan(spark, sf_dir):
    plan = budget_plan(_counted_catalog(spark, sf_dir), epochs=10, batch_size=32, base_lr=3e-5, lr_denominator=1024.0)
    return plan.select(
        "name", "n_rows", F.round("scaled_lr", 12).alias("scaled_lr"), F.round("weight_decay", 9).alias("weight_decay")
    )


def _outcomes(spark, sf_dir, cases):
    """What a check says of each (case, table, call), beside the rows of the table."""
    out = None
    for case, name, call in cases:
        df = table(spark, sf_dir, name)
        try:
            call(df)
            said = "ok"
        except (KeyError, ValueError) as e:
            said = type(e).__name__
        row = df.agg(F.count("*").alias("n")).select(F.lit(case).alias("case"), F.lit(said).alias("outcome"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _outcomes_sql(rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{case}' AS \"case\", '{said}' AS outcome, (SELECT count(*) FROM {name}) AS n" for case, name, said in rows
    )


@check("chk_required", _outcomes_sql([("all there", "documents", "ok"), ("one missing", "documents", "KeyError"), ("none asked", "pages", "ok")]))
def chk_required(spark, sf_dir):
    return _outcomes(spark, sf_dir, [
        ("all there", "documents", lambda df: require_columns(df, ["text", "lang"])),
        ("one missing", "documents", lambda df: require_columns(df, ["text", "smiles"])),
        ("none asked", "pages", lambda df: require_columns(df, [])),
    ])


ARITY = [("every label", "*", 2, "classification", "ok"), ("too few", "quality", 2, "classification", "ValueError"),
         ("too many", "*", 1, "regression", "ValueError"), ("unknown name", "missing", 1, "mtr", "ValueError"), ("no labels", None, 3, "mlm", "ok")]


@check("chk_arity", _outcomes_sql([(case, "labels", said) for case, *_, said in ARITY]))
def chk_arity(spark, sf_dir):
    def call(labels, k, task):
        return lambda df: check_arity(resolve_labels(df, "doc_id", labels), k, task, df.columns)

    return _outcomes(spark, sf_dir, [(case, "labels", call(labels, k, task)) for case, labels, k, task, _ in ARITY])


TASK_CASES = [*((task, "ok") for task in ("mlm", "classification", "regression", "mtr")), ("ranking", "ValueError"), ("MLM", "ValueError")]


@check("chk_task", _outcomes_sql([(task, "documents", said) for task, said in TASK_CASES]))
def chk_task(spark, sf_dir):
    return _outcomes(spark, sf_dir, [(task, "documents", lambda _, task=task: check_task(task)) for task, _ in TASK_CASES])


@check(
    "src_split_record",
    """
    SELECT split, doc_id AS row_idx, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos_in_split
    FROM (SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM documents)
    """,
)
def src_split_record(spark, sf_dir):
    # The one-object form, as another program would leave it beside a data file.
    place = F.col("doc_id") % 10
    parts = {"train": place < 8, "val": place == 8, "test": place == 9}
    lists = [F.array_sort(F.collect_list(F.when(hit, F.col("doc_id")))).alias(name) for name, hit in parts.items()]
    data = new_path(spark, "data") + ".csv"
    table(spark, sf_dir, "documents").agg(*lists).write.json(split_record_path(data))
    rows = read_split_record(spark, data)
    return rows.select("split", "row_idx", F.col("pos_in_split").cast("bigint").alias("pos_in_split"))


@check("prj_clean_index", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_partkey, p_name, p_size FROM part")
def prj_clean_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").orderBy("p_partkey")
    raw = part.select(
        F.col("p_partkey").alias("Unnamed: 0"), "p_partkey", "p_name", "p_size", (F.col("p_size") * 2).alias("index")
    )
    path = new_path(spark, "raw") + ".csv"
    write_csv(raw, path)
    cleaned = clean_index(read_csv(spark, path, raw.schema), "p_name")
    return cleaned.select("row_idx", "p_partkey", "p_name", "p_size")


@check("prj_labels", "SELECT p_name, p_size, p_retailprice FROM part")
def prj_labels(spark, sf_dir):
    return keep_labels(table(spark, sf_dir, "part"), "p_name", ["p_size", "p_retailprice", "not_there"])


@check("prj_labels_all", "SELECT p_name, p_partkey, p_brand, p_type, p_size, p_retailprice FROM part")
def prj_labels_all(spark, sf_dir):
    return keep_labels(table(spark, sf_dir, "part"), "p_name", "*")


@check(
    "spl_files",
    """
    SELECT CASE WHEN l.doc_id IS NULL THEN 'train' ELSE 'validation' END AS split,
           count(*) AS n, sum(n_chars)::BIGINT AS sum_chars
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
    """,
)
def spl_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    paths = {}
    for split, how in (("train", "left_anti"), ("valid", "left_semi")):
        paths[split] = new_path(spark, split) + ".csv"
        write_csv(docs.join(labels, "doc_id", how), paths[split])
    both = splits_from_files(*[read_csv(spark, p, docs.schema) for p in paths.values()])
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("sum_chars"))
