"""Queries on corpus preparation, batches, schedules and losses. Pairs are a user turn and the assistant turn after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schedule import early_stopping, minutes, teacher_forcing
from ..operators import dataset, seq2seq, synchronous
from ..sources import batch_files, model_files, pairs
from ..store import scratch, written

SEED, SIZE = 7, 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark, sf_dir):
    return pairs.pairs_from_turns(read(spark, sf_dir, "conversations"))


def with_gaps(spark, sf_dir):
    """Documents where every fifth language and every seventh source is missing."""
    d = read(spark, sf_dir, "documents")
    gap = lambda c, k: F.when(F.col("doc_id") % k != 0, F.col(c)).alias(c)
    return d.select("doc_id", gap("lang", 5), gap("source", 7))


def csv_scan(spark, sf_dir):
    """Turns written as CSV and read as pairs: role and text, where a document's text may be a null marker or hold quotes."""
    path = scratch(spark, "pairs")
    t = read(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") == 1, F.lit("None")).when(F.col("turn") == 2, F.concat(F.lit('"'), F.col("text"), F.lit('"'))).when(F.col("turn") == 3, F.lit(" nan ")).otherwise(F.col("text"))
    pairs.write_csv(t.select(F.col("role").alias("en"), text.alias("fr"), F.col("conv_id")), path)
    return pairs.pair_csv(spark, path)


def tsv_scan(spark, sf_dir):
    """Documents' sources and languages as lines of one file, every third line with one field only: the first 600 lines."""
    path = scratch(spark, "lines")
    d = read(spark, sf_dir, "documents")
    line = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.concat_ws("\t", "source", "lang", F.col("n_chars").cast("string")))
    d.select("doc_id", line.alias("value")).repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return pairs.pair_tsv(spark, path, 600)


def head_fraction(spark, sf_dir):
    d = pairs.with_ordinals(read(spark, sf_dir, "documents").select("doc_id", "lang"), "line_no", "doc_id")
    return d.where(F.col("line_no") <= pairs.line_limit(d.count(), 0.3)).select("line_no", "doc_id", "lang")


def head_lines(spark, sf_dir):
    d = pairs.with_ordinals(read(spark, sf_dir, "documents").select("doc_id", "lang"), "line_no", "doc_id")
    return d.where(F.col("line_no") <= pairs.line_limit(0, 100)).where(F.col("lang") != "de").select("line_no", "doc_id", "lang")


def sample_script(spark, sf_dir):
    """First of equal texts, no nulls, then 17 % of those; sample_fraction draws from all rows."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return dataset.sample_fraction(written(dataset.first_per_key(d, "text", "doc_id").na.drop("any"), "unique"), "doc_id", 0.17, SEED).select("doc_id", "lang")


def _examples(spark, sf_dir):
    """Pairs as ids of their characters, by a vocabulary of all characters."""
    c = written(corpus(spark, sf_dir), "pairs")
    chars = lambda x: F.filter(F.split(x, ""), lambda y: y != "")
    both = c.select(F.explode(chars(F.concat("src", "tgt"))).alias("token"))
    vocab = written(dataset.vocabulary(both), "vocabulary")
    src = dataset.ids(c.select("pair_id", chars(F.col("src")).alias("tokens")), vocab, "pair_id").select("pair_id", dataset.source_example(F.col("ids")).alias("src"))
    tgt = dataset.ids(c.select("pair_id", chars(F.col("tgt")).alias("tokens")), vocab, "pair_id").select("pair_id", dataset.target_example(F.col("ids")).alias("tgt"))
    return src.join(tgt, "pair_id"), vocab


def _batches(spark, sf_dir):
    examples, _ = _examples(spark, sf_dir)
    return written(dataset.batched(examples, "pair_id", SIZE), "batches")


def _digest(c):
    return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " "))


def batches_padded(spark, sf_dir):
    p = dataset.padded(_batches(spark, sf_dir), "src", "tgt")
    return p.select("pair_id", "batch_id", "pos_in_batch", _digest(F.col("src")).alias("src_md5"), _digest(F.col("tgt")).alias("tgt_md5"))


def batches_files(spark, sf_dir):
    """Padded batches written as tensors and read back."""
    path = scratch(spark, "tensors")
    batch_files.write_batches(dataset.padded(_batches(spark, sf_dir), "src", "tgt"), path, "pair_id", "src", "tgt")
    p = batch_files.read_rows(spark, path, "pair_id")
    return p.select("pair_id", "batch_id", "pos_in_batch", _digest(F.col("src")).alias("src_md5"), _digest(F.col("tgt")).alias("tgt_md5"))


def batch_widths(spark, sf_dir):
    p = dataset.padded(_batches(spark, sf_dir), "src", "tgt")
    return p.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("src")).cast("bigint").alias("src_width"), F.max(F.size("tgt")).cast("bigint").alias("tgt_width"))


def shifted_targets(spark, sf_dir):
    examples, _ = _examples(spark, sf_dir)
    return examples.select("pair_id", _digest(dataset.decoder_input(F.col("tgt"))).alias("input_md5"), _digest(dataset.decoder_label(F.col("tgt"))).alias("label_md5"))


def _logits(spark, sf_dir):
    """Embeddings as logits, their labels as targets (0: padding), 32 to a batch."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 32).alias("batch_id"), F.col("label").alias("target"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


def _losses(spark, sf_dir):
    """A run for each label: its vectors' first numbers as losses of epochs."""
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("run"), "vec_id", F.round(F.abs(F.col("embedding")[0].cast("double")), 6).alias("loss"))
    from pyspark.sql import Window

    return e.select("run", (F.row_number().over(Window.partitionBy("run").orderBy("vec_id")) - 1).alias("epoch"), "loss")


def _tiny(spark, sf_dir):
    examples, vocab = _examples(spark, sf_dir)
    n = vocab.count() + 4
    return examples, seq2seq.Seq2Seq(n, n, hidden=8, layers=2, embedding=6)


def seq2seq_forward(spark, sf_dir):
    """Validation losses by batch of an untrained small network, greedy."""
    examples, model = _tiny(spark, sf_dir)
    batches = dataset.padded(written(dataset.batched(examples, "pair_id", SIZE), "batches"), "src", "tgt")
    return seq2seq.score_batches(batches, model).select("batch_id", F.round("loss", 6).alias("loss"), "n_labels", F.size("greedy").alias("n_greedy"))


def seq2seq_train(spark, sf_dir):
    """A small network trained for a few epochs on all pairs in whole length, but for those held for validation."""
    examples, model = _tiny(spark, sf_dir)
    parts = dataset.split(written(examples, "examples"), "pair_id", seed=SEED)
    rows = seq2seq.fit_distributed(model, parts, epochs=4, size=32, rate=0.01, tf=(1.0, 0.0, 1, 3))
    return spark.createDataFrame([(r["epoch"], r["tf_ratio"], r["train_loss"], r["val_loss"]) for r in rows], "epoch int, tf_ratio double, train_loss double, val_loss double")


def seq2seq_train_synchronous(spark, sf_dir):
    """The same by shared steps, on draws from the whole training set: one epoch, then taken up again by a new network for the second."""
    examples, model = _tiny(spark, sf_dir)
    parts, path = written(dataset.split(written(examples, "examples"), "pair_id", seed=SEED), "parts"), scratch(spark, "generations")
    for epochs in (1, 2):
        again = seq2seq.Seq2Seq(model.source_size, model.target_size, hidden=8, layers=2, embedding=6)
        rows = synchronous.fit_synchronous(again, parts, path, epochs=epochs, size=32, rate=0.01, tf=(1.0, 0.0, 0, 2))
    return spark.createDataFrame([tuple(r[k] for k in synchronous.FIGURES) for r in rows], "epoch int, tf_ratio double, train_loss double, val_loss double")


def weights_roundtrip(spark, sf_dir):
    """A network's weights written and read: whether they came back, by parameter."""
    _, model = _tiny(spark, sf_dir)
    path = scratch(spark, "weights")
    model_files.save_weights(spark, model.p, path)
    back = model_files.load_weights(spark, path)
    return spark.createDataFrame([(k, int(v.size), bool((back[k] == v.astype("float32")).all())) for k, v in sorted(model.p.items())], "param string, n long, equal boolean")


QUERIES = {
    "csv_scan": csv_scan,
    "tsv_scan": tsv_scan,
    "pairs_from_turns": corpus,
    "drop_null_rows": lambda s, d: with_gaps(s, d).na.drop("any"),
    "row_count": lambda s, d: with_gaps(s, d).agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("n_lang"), F.count("source").alias("n_source")),
    "dedup_first": lambda s, d: dataset.first_per_key(read(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("text_md5")),
    "head_lines": head_lines,
    "head_fraction": head_fraction,
    "sample_fraction": lambda s, d: dataset.sample_fraction(read(s, d, "documents").select("doc_id", "lang"), "doc_id", 0.17, SEED),
    "sample_script": sample_script,
    "sample_independent": lambda s, d: dataset.sample_columns(written(corpus(s, d), "pairs"), 50, SEED).select("pos", F.md5("src").alias("src_md5"), F.md5("tgt").alias("tgt_md5")),
    "train_val_split": lambda s, d: dataset.split(read(s, d, "documents").select("doc_id"), "doc_id", 0.1, SEED),
    "bootstrap_epoch": lambda s, d: dataset.bootstrap(read(s, d, "documents").select("doc_id"), "doc_id", 0.7, 3, SEED),
    "batches_padded": batches_padded,
    "batches_files": batches_files,
    "batch_widths": batch_widths,
    "shifted_targets": shifted_targets,
    "worker_chunks": lambda s, d: dataset.chunks(read(s, d, "documents").select("doc_id"), 7, "doc_id"),
    "tf_schedule": lambda s, d: _losses(s, d).select("run", "epoch", F.round(teacher_forcing(F.col("epoch"), 1.0, 0.0, 5, 20), 9).alias("ratio")),
    "early_stopping": lambda s, d: early_stopping(_losses(s, d), 0.01, 4, 3),
    "masked_ce": lambda s, d: dataset.masked_loss(_logits(s, d)).select("batch_id", F.round("loss", 6).alias("loss")),
    "epoch_loss": lambda s, d: dataset.epoch_loss(dataset.masked_loss(_logits(s, d))).select(F.round("loss", 6).alias("loss")),
    "format_time": lambda s, d: read(s, d, "documents").select("doc_id", minutes(F.col("n_chars") / 8).alias("took")),
    "seq2seq_forward": seq2seq_forward,
    "seq2seq_counts": lambda s, d: seq2seq_forward(s, d).select("batch_id", "n_labels", F.col("n_greedy").cast("long").alias("n_greedy")),
    "sample_columns_share": lambda s, d: dataset.sample_columns(written(corpus(s, d), "pairs"), 0.4, SEED).select("pos", F.md5("src").alias("src_md5"), F.md5("tgt").alias("tgt_md5")),
    "seq2seq_train": seq2seq_train,
    "seq2seq_train_synchronous": seq2seq_train_synchronous,
    "weights_roundtrip": weights_roundtrip,
}

_MARKERS = ", ".join(f"'{m}'" for m in pairs.NULL_MARKERS)
_PAIRS = """pairs AS (
  SELECT CAST(row_number() OVER (ORDER BY a.conv_id, a.turn) AS BIGINT) AS pair_id, a.text AS src, b.text AS tgt
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""
_CHARS = "[substr({0}, i, 1) for i in range(1, length({0}) + 1)]"
_IDS = f"""{_PAIRS},
v AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM (SELECT DISTINCT unnest({_CHARS.format("(src || tgt)")}) AS token FROM pairs)),
ch AS (SELECT pair_id, 's' AS side, unnest({_CHARS.format("src")}) AS token, unnest(range(1, length(src) + 1)) AS pos FROM pairs UNION ALL SELECT pair_id, 't', unnest({_CHARS.format("tgt")}), unnest(range(1, length(tgt) + 1)) FROM pairs),
il AS (SELECT pair_id, list(v.id ORDER BY pos) FILTER (side = 's') AS s, list(v.id ORDER BY pos) FILTER (side = 't') AS t FROM ch JOIN v ON ch.token = v.token GROUP BY pair_id),
x AS (SELECT pairs.pair_id, list_concat(coalesce(s, []), [2]) AS src, list_concat([1], coalesce(t, []), [2]) AS tgt FROM pairs LEFT JOIN il ON pairs.pair_id = il.pair_id),
bt AS (SELECT *, (row_number() OVER (ORDER BY pair_id) - 1) // {SIZE} AS batch_id, (row_number() OVER (ORDER BY pair_id) - 1) % {SIZE} AS pos_in_batch FROM x),
pd AS (SELECT *, max(len(src)) OVER (PARTITION BY batch_id) AS sw, max(len(tgt)) OVER (PARTITION BY batch_id) AS tw FROM bt)"""
_ORDER = f"md5(CAST({{0}} AS VARCHAR) || '-{SEED}'), {{0}}"
_DRAW = f"CAST(('0x' || substr(md5(CAST(draw AS VARCHAR) || '-3-{SEED}'), 1, 8)) AS BIGINT)"
_LOGITS = """g AS (SELECT vec_id // 32 AS batch_id, label, [CAST(x AS DOUBLE) for x in embedding] AS y FROM embeddings),
ce AS (SELECT batch_id, avg(CASE WHEN label <> 0 THEN ln(list_sum([exp(z - list_max(y)) for z in y])) + list_max(y) - y[label + 1] END) AS loss FROM g GROUP BY batch_id)"""
_GAPS = "(SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 7 <> 0 THEN source END AS source FROM documents)"

SQL = {
    "csv_scan": f"""SELECT role AS src, t AS tgt FROM (SELECT role, CASE turn WHEN 1 THEN 'None' WHEN 2 THEN '"' || text || '"' WHEN 3 THEN ' nan ' ELSE text END AS t FROM conversations) WHERE t NOT IN ({_MARKERS}) AND role NOT IN ({_MARKERS})""",
    "tsv_scan": "SELECT CAST(n AS BIGINT) AS pair_id, source AS src, lang AS tgt FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n < 600 AND doc_id % 3 <> 0",
    "pairs_from_turns": f"WITH {_PAIRS} SELECT * FROM pairs",
    "drop_null_rows": f"SELECT * FROM {_GAPS} WHERE lang IS NOT NULL AND source IS NOT NULL",
    "row_count": f"SELECT count(*) AS n, count(lang) AS n_lang, count(source) AS n_source FROM {_GAPS}",
    "dedup_first": "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text",
    "head_lines": "SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) AS line_no, doc_id, lang FROM documents) WHERE line_no <= 100 AND lang <> 'de'",
    "head_fraction": "SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id) AS line_no, doc_id, lang FROM documents) WHERE line_no <= floor(0.3 * (SELECT count(*) FROM documents))",
    "sample_fraction": f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {_ORDER.format('doc_id')}) AS n FROM documents) WHERE n <= round(0.17 * (SELECT count(*) FROM documents))",
    "sample_script": f"WITH u AS (SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text) SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER.format('doc_id')}) AS n FROM u) WHERE n <= round_even(0.17 * (SELECT count(*) FROM u), 0)",
    "sample_independent": f"""WITH {_PAIRS},
a AS (SELECT row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || '-{SEED}'), pair_id) AS pos, src FROM pairs), b AS (SELECT row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || '-{SEED + 1}'), pair_id) AS pos, tgt FROM pairs)
SELECT a.pos, md5(src) AS src_md5, md5(tgt) AS tgt_md5 FROM a JOIN b ON a.pos = b.pos WHERE a.pos <= 50""",
    "sample_columns_share": f"""WITH {_PAIRS},
a AS (SELECT row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || '-{SEED}'), pair_id) AS pos, src FROM pairs), b AS (SELECT row_number() OVER (ORDER BY md5(CAST(pair_id AS VARCHAR) || '-{SEED + 1}'), pair_id) AS pos, tgt FROM pairs)
SELECT a.pos, md5(src) AS src_md5, md5(tgt) AS tgt_md5 FROM a JOIN b ON a.pos = b.pos WHERE a.pos <= floor(0.4::DOUBLE * (SELECT count(*) FROM pairs))""",
    "seq2seq_counts": f"WITH {_IDS} SELECT batch_id, CAST(sum(len(tgt) - 1) AS BIGINT) AS n_labels, CAST(count(*) * (max(tw) - 1) AS BIGINT) AS n_greedy FROM pd GROUP BY batch_id",
    "train_val_split": f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_ORDER.format('doc_id')}) <= floor(0.1 * (SELECT count(*) FROM documents)) THEN 'val' ELSE 'train' END AS part FROM documents",
    "bootstrap_epoch": f"WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents), c AS (SELECT count(*) AS n FROM documents) SELECT draw, o.doc_id FROM (SELECT range AS draw FROM range(0, (SELECT CAST(floor(0.7 * n) AS BIGINT) FROM c))) r JOIN o ON o.n = {_DRAW} % (SELECT n FROM c)",
    "batches_padded": f"WITH {_IDS} SELECT pair_id, batch_id, pos_in_batch, md5(array_to_string(list_resize(src, sw, 0), ' ')) AS src_md5, md5(array_to_string(list_resize(tgt, tw, 0), ' ')) AS tgt_md5 FROM pd",
    "batches_files": f"WITH {_IDS} SELECT pair_id, batch_id, pos_in_batch, md5(array_to_string(list_resize(src, sw, 0), ' ')) AS src_md5, md5(array_to_string(list_resize(tgt, tw, 0), ' ')) AS tgt_md5 FROM pd",
    "batch_widths": f"WITH {_IDS} SELECT batch_id, count(*) AS n, max(sw) AS src_width, max(tw) AS tgt_width FROM pd GROUP BY batch_id",
    "shifted_targets": f"WITH {_IDS} SELECT pair_id, md5(array_to_string(tgt[1:len(tgt) - 1], ' ')) AS input_md5, md5(array_to_string(tgt[2:len(tgt)], ' ')) AS label_md5 FROM x",
    "worker_chunks": "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) AS INTEGER) AS chunk FROM documents",
    "tf_schedule": "SELECT run, CAST(epoch AS INTEGER) AS epoch, CASE WHEN epoch <= 5 THEN 1.0::DOUBLE WHEN epoch >= 20 THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE - (epoch - 5) / 15.0::DOUBLE, 9) END AS ratio FROM (SELECT label AS run, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS epoch FROM embeddings)",
    "early_stopping": """WITH RECURSIVE l AS (SELECT label AS run, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS epoch, round(abs(CAST(embedding[1] AS DOUBLE)), 6) AS loss FROM embeddings),
s(run, epoch, best, best_epoch, bad, stop) AS (
  SELECT DISTINCT run, CAST(-1 AS BIGINT), CAST('inf' AS DOUBLE), CAST(NULL AS BIGINT), 0, FALSE FROM l
  UNION ALL
  SELECT s.run, l.epoch, CASE WHEN l.loss < s.best - 0.01::DOUBLE THEN l.loss ELSE s.best END, CASE WHEN l.loss < s.best - 0.01::DOUBLE THEN l.epoch ELSE s.best_epoch END,
    CASE WHEN l.loss < s.best - 0.01::DOUBLE OR l.epoch < 3 THEN 0 ELSE s.bad + 1 END, NOT (l.loss < s.best - 0.01::DOUBLE OR l.epoch < 3) AND s.bad + 1 >= 4
  FROM s JOIN l ON l.run = s.run AND l.epoch = s.epoch + 1 WHERE NOT s.stop),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS n FROM s)
SELECT run, CAST(CASE WHEN stop THEN epoch END AS INTEGER) AS stop_epoch, CAST(best_epoch AS INTEGER) AS best_epoch, best AS best_loss, CAST(CASE WHEN stop THEN best_epoch ELSE epoch END AS INTEGER) AS kept_epoch FROM f WHERE n = 1""",
    "masked_ce": f"WITH {_LOGITS} SELECT batch_id, round(loss, 6) AS loss FROM ce",
    "epoch_loss": f"WITH {_LOGITS} SELECT round(avg(loss), 6) AS loss FROM ce",
    "weights_roundtrip": f"""WITH {_PAIRS}, v AS (SELECT count(DISTINCT token) + 4 AS v FROM (SELECT unnest({_CHARS.format("(src || tgt)")}) AS token FROM pairs)),
cell AS (SELECT * FROM (VALUES ('dec0', 6, 16), ('dec1', 16, 16), ('enc0.bwd', 6, 8), ('enc0.fwd', 6, 8), ('enc1.bwd', 16, 8), ('enc1.fwd', 16, 8)) AS c(name, wide, hidden)),
x AS (SELECT name || '.b' AS param, 4 * hidden AS n FROM cell UNION ALL SELECT name || '.wh', 4 * hidden * hidden FROM cell UNION ALL SELECT name || '.wx', 4 * hidden * wide FROM cell
  UNION ALL SELECT 'out.b', v FROM v UNION ALL SELECT 'out.w', 16 * v FROM v UNION ALL SELECT 'source', 6 * v FROM v UNION ALL SELECT 'target', 6 * v FROM v)
SELECT param, CAST(n AS BIGINT) AS n, TRUE AS equal FROM x""",
    "format_time": "SELECT doc_id, CAST(CAST(floor(n_chars / 8 / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(n_chars / 8 - 60 * floor(n_chars / 8 / 60)) AS BIGINT) AS VARCHAR) || 's' AS took FROM documents",
}

