"""Queries on words, pairs, training and encoding, over the table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import UNKNOWN, WORD_END, merged, segmented, unsegmented
from ..operators import cache, counts, dataset, encode, train
from ..operators.encode import Model
from ..sources import model_files
from ..store import scratch, written

#: Merges of most queries that SQL repeats by counting all pairs for each, and of those with the operators' production size: the cache and
#: strict ids have SQL that counts changes, the others none; tests hold them against plain programs.
MERGES, PRODUCTION, TOP = 12, 4500, 20


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def of_lang(spark, sf_dir, lang):
    return docs(spark, sf_dir).where(F.col("lang") == lang)


def counted(spark, sf_dir):
    return counts.word_counts(docs(spark, sf_dir))


def split(spark, sf_dir):
    return counts.with_symbols(counted(spark, sf_dir))


def model(words_: DataFrame, merges: int = MERGES) -> Model:
    """words_: word, freq. Alphabets are small and rules few, so both are the driver's."""
    rules = sorted((x["rank"], x["l"], x["r"]) for x in train.train(words_, merges).collect())
    return Model.learned([(a, b) for _, a, b in rules], [x["symbol"] for x in counts.alphabet(words_).collect()])


def joined(tokens):
    return F.array_join(tokens, " ")


def segmented_words(spark, sf_dir):
    return split(spark, sf_dir).select("word", "freq", joined(F.col("symbols")).alias("segmented"))


def pair_postings(spark, sf_dir):
    p = counts.pair_postings(split(spark, sf_dir))
    return p.select("l", "r", "n_words", F.md5(F.array_join("words", " ")).alias("words_md5"))


def words_of_pairs(spark, sf_dir):
    """The words that hold one of the top pairs, by the index of pairs."""
    s = written(split(spark, sf_dir), "split")
    return counts.words_with(counts.pair_postings(s), counts.top_pairs(counts.pair_counts(s), TOP))


def merge_once(spark, sf_dir):
    s = written(split(spark, sf_dir), "split")
    best = counts.top_pairs(counts.pair_counts(s))
    return _merge(s, best.head())


def _merge(s: DataFrame, best) -> DataFrame:
    again = unsegmented(merged(segmented(F.col("symbols")), F.lit(best["l"]), F.lit(best["r"]))) if best else F.col("symbols")
    return s.select("word", "freq", joined(again).alias("merged"))


def bpe_train_rules(spark, sf_dir):
    return train.train(counted(spark, sf_dir), MERGES)


def bpe_train_kernel(spark, sf_dir):
    return train.train_in_one_task(counted(spark, sf_dir), MERGES)


def bpe_train_by_lang(spark, sf_dir):
    return train.train_by(counts.word_counts(docs(spark, sf_dir), "lang"), "lang", MERGES)


def token_set(spark, sf_dir):
    words_ = written(counted(spark, sf_dir), "words")
    rules = train.train(words_, MERGES)
    own = counts.alphabet(words_).select(F.col("symbol").alias("token"))
    return own.union(spark.createDataFrame([(WORD_END,)], "token string")).union(rules.select(F.concat("l", "r"))).distinct()


def rule_ranks(spark, sf_dir):
    """Rules as a file may give them: the top pairs, then the first five of them again."""
    top = [(x["l"], x["r"]) for x in counts.top_pairs(counts.pair_counts(split(spark, sf_dir)), TOP).collect()]
    return model_files.rules_table(spark, Model(top + top[:5], []))


def _encoded(spark, sf_dir, how):
    words_ = written(counted(spark, sf_dir), "words")
    return how(words_.select("word"), model(words_))


def encode_words_sweep(spark, sf_dir):
    return _encoded(spark, sf_dir, encode.sweep_words).select("word", joined(F.col("tokens")).alias("tokens"))


def encode_words_rank(spark, sf_dir):
    return _encoded(spark, sf_dir, encode.encode_words).select("word", joined(F.col("tokens")).alias("tokens"))


def _encoded_texts(spark, sf_dir, merges=MERGES):
    return encode.encode_batch(docs(spark, sf_dir), model(written(counted(spark, sf_dir), "words"), merges))


def _sized(e: DataFrame) -> DataFrame:
    return e.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(joined(F.col("tokens"))).alias("tokens_md5"))


def encode_documents(spark, sf_dir, merges=MERGES):
    return _sized(_encoded_texts(spark, sf_dir, merges))


def encode_documents_join(spark, sf_dir):
    return _sized(encode.encode_texts(docs(spark, sf_dir), _encoded(spark, sf_dir, encode.encode_words)))


def encoding_cache(spark, sf_dir):
    """The encodings of all words, kept by a cache that was filled by one language after the other: each encodes what is new in it."""
    words_ = written(counted(spark, sf_dir), "words")
    kept = cache.EncodingCache(spark, scratch(spark, "encodings"), model(words_, PRODUCTION))
    d = docs(spark, sf_dir)
    for lang in sorted(r["lang"] for r in d.select("lang").where("lang IS NOT NULL").distinct().collect()):
        kept.fill(counts.distinct_words(d.where(F.col("lang") == lang)), lang)
    return kept.rows().select("word", joined(F.col("tokens")).alias("tokens"), F.col("batch").alias("lang"))


def encode_documents_cached(spark, sf_dir):
    """All texts, by a cache that has the words of English texts already."""
    kept = cache.EncodingCache(spark, scratch(spark, "encodings"), model(written(counted(spark, sf_dir), "words"), PRODUCTION))
    kept.fill(counts.distinct_words(of_lang(spark, sf_dir, "en")))
    return _sized(kept.encode(docs(spark, sf_dir)))


def token_freq(spark, sf_dir):
    """Tokens of all texts, counted: each distinct word's tokens by its frequency, so no text is encoded."""
    words_ = written(counted(spark, sf_dir), "words")
    e = encode.encode_words(words_.select("word"), model(words_)).join(words_, "word")
    return e.select("freq", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("freq").alias("n"))


def _unseen(spark, sf_dir, drop):
    m = model(counts.word_counts(of_lang(spark, sf_dir, "en")))
    e = encode.encode_words(counts.distinct_words(of_lang(spark, sf_dir, "fr")), m, drop)
    return e.select("word", joined(F.col("tokens")).alias("tokens"))


def uncached_words(spark, sf_dir):
    cache = counts.distinct_words(of_lang(spark, sf_dir, "en"))
    return encode.uncached(counts.distinct_words(of_lang(spark, sf_dir, "fr")), cache)


def encodings_upsert(spark, sf_dir):
    """Encodings of English words, brought up to date with those of French ones; the words' origins tell which won."""
    old = counts.distinct_words(of_lang(spark, sf_dir, "en")).withColumn("origin", F.lit("cache"))
    new = counts.distinct_words(of_lang(spark, sf_dir, "fr")).withColumn("origin", F.lit("worker"))
    return encode.upsert(old, new)


def _vocabulary(spark, sf_dir):
    return dataset.vocabulary(token_set(spark, sf_dir))


def add_tokens(spark, sf_dir):
    """The vocabulary of English letters, with all letters added."""
    own = dataset.vocabulary(counts.alphabet(counts.word_counts(of_lang(spark, sf_dir, "en"))).select(F.col("symbol").alias("token")))
    return dataset.add_tokens(written(own, "vocabulary"), counts.alphabet(counted(spark, sf_dir)).select(F.col("symbol").alias("token")))


def _numbers(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("ids_md5"))


def token_ids(spark, sf_dir):
    """Tokens with letters of English alone as the vocabulary."""
    vocab = dataset.vocabulary(counts.alphabet(counts.word_counts(of_lang(spark, sf_dir, "en"))).select(F.col("symbol").alias("token")))
    return _numbers(dataset.ids(_encoded_texts(spark, sf_dir), written(vocab, "vocabulary"), "doc_id"))


def token_ids_production(spark, sf_dir):
    """Texts as ids of the learned tokens, by rules and vocabulary of production size, learned once."""
    m = model(written(counted(spark, sf_dir), "words"), PRODUCTION)
    vocab = written(dataset.vocabulary(spark.createDataFrame([(t,) for t in m.tokens], "token string")), "vocabulary")
    return _numbers(dataset.ids(encode.encode_batch(docs(spark, sf_dir), m), vocab, "doc_id", True))


def model_json_roundtrip(spark, sf_dir):
    words_ = written(counted(spark, sf_dir), "words")
    path = scratch(spark, "tokenizer") + "/"
    model_files.save_json(spark, model(words_), path)
    return model_files.rules_table(spark, model_files.load_json(spark, path))


def model_json_legacy(spark, sf_dir):
    words_ = written(counted(spark, sf_dir), "words")
    path = scratch(spark, "tokenizer") + "/"
    model_files.save_json(spark, model(words_), path)
    m = model_files.load_json_legacy(spark, path, "<other>")
    return spark.createDataFrame([(t, m.unknown, m.word_end) for t in m.tokens], "token string, unknown string, word_end string")


def model_tables_roundtrip(spark, sf_dir):
    words_ = written(counted(spark, sf_dir), "words")
    path = scratch(spark, "tokenizer")
    model_files.save_tables(spark, model(words_), path)
    return model_files.rules_table(spark, model_files.load_tables(spark, path))


def encode_stream(spark, sf_dir):
    """Documents read as a stream, encoded as they come."""
    from ..streaming.encode import encode_stream as run

    words_ = written(counted(spark, sf_dir), "words")
    texts = spark.readStream.schema(docs(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parquet*")
    out = scratch(spark, "stream")
    run(texts.select("doc_id", "text"), model(words_), out, scratch(spark, "stream-state")).awaitTermination()
    return _sized(spark.read.parquet(out))


QUERIES = {
    "word_counts": counted,
    "word_counts_by_lang": lambda s, d: counts.word_counts(docs(s, d), "lang"),
    "distinct_words": lambda s, d: counts.distinct_words(docs(s, d)),
    "alphabet": lambda s, d: counts.alphabet(counted(s, d)),
    "segmented_words": segmented_words,
    "pair_counts": lambda s, d: counts.pair_counts(split(s, d)),
    "pair_counts_lead": lambda s, d: counts.pair_counts_by_window(split(s, d)),
    "top_pair": lambda s, d: counts.top_pairs(counts.pair_counts(split(s, d))),
    "top_pairs_k": lambda s, d: counts.top_pairs(counts.pair_counts(split(s, d)), TOP),
    "pair_postings": pair_postings,
    "words_of_pairs": words_of_pairs,
    "merge_once": merge_once,
    "bpe_train_rules": bpe_train_rules,
    "bpe_train_production": lambda s, d: train.train(counted(s, d), PRODUCTION),
    "bpe_train_kernel": bpe_train_kernel,
    "bpe_train_by_lang": bpe_train_by_lang,
    "token_set": token_set,
    "rule_ranks": rule_ranks,
    "encode_words_sweep": encode_words_sweep,
    "encode_words_rank": encode_words_rank,
    "encode_documents": encode_documents,
    "encode_documents_join": encode_documents_join,
    "encode_documents_cached": encode_documents_cached,
    "encoding_cache": encoding_cache,
    "encode_documents_production": lambda s, d: encode_documents(s, d, PRODUCTION),
    "encode_stream": encode_stream,
    "token_freq": token_freq,
    "encode_oov_replace": lambda s, d: _unseen(s, d, False),
    "encode_oov_drop": lambda s, d: _unseen(s, d, True),
    "uncached_words": uncached_words,
    "encodings_upsert": encodings_upsert,
    "vocab_ids": _vocabulary,
    "vocab_add_tokens": add_tokens,
    "token_ids": token_ids,
    "token_ids_strict": token_ids_production,
    "token_ids_production": token_ids_production,
    "model_json_roundtrip": model_json_roundtrip,
    "model_json_legacy": model_json_legacy,
    "model_tables_roundtrip": model_tables_roundtrip,
}

_PAT = r"[\p{L}\p{N}]+(?:[''\-][\p{L}\p{N}]+)*''?"


def _words(where: str = "") -> str:
    return f"SELECT word, CAST(count(*) AS BIGINT) AS freq FROM (SELECT unnest(regexp_extract_all(text, '{_PAT}')) AS word FROM documents {where}) GROUP BY word"


_SYMBOLS = f"list_concat([substr(word, i, 1) for i in range(1, length(word) + 1)], ['{WORD_END}'])"


def _pairs(where: str = "") -> str:
    """Words, symbols, and counts of adjacent pairs."""
    return f"""
w AS MATERIALIZED ({_words(where)}),
s AS (SELECT word, freq, {_SYMBOLS} AS symbols FROM w),
p AS (SELECT word, freq, symbols[i] AS l, symbols[i + 1] AS r FROM (SELECT word, freq, symbols, unnest(range(1, len(symbols))) AS i FROM s)),
pc AS (SELECT l, r, CAST(sum(freq) AS BIGINT) AS n FROM p GROUP BY l, r),
"""


#: Letters, tokens and their ids.
_TOKENS = f"""al AS (SELECT DISTINCT unnest([substr(word, i, 1) for i in range(1, length(word) + 1)]) AS symbol FROM w),
ts AS (SELECT symbol AS token FROM al UNION SELECT '{WORD_END}' UNION SELECT l || r FROM rules),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 3 AS INTEGER) AS id FROM ts),
"""


def _with(where: str = "") -> str:
    """Words, symbols, pairs; then the rules, one merge a step."""
    return f"""{_pairs(where)}
start AS (SELECT list(chr(1) || array_to_string(symbols, chr(2) || chr(1)) || chr(2) ORDER BY word) AS ws, list(freq ORDER BY word) AS fs FROM s),
step(k, ws, fs, l, r, n) AS (
  SELECT 0, ws, fs, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM start
  UNION ALL
  SELECT k + 1, list_transform(ws, lambda x: replace(x, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || b.r || chr(2))), fs, b.l, b.r, b.n
  FROM (SELECT *, (SELECT arg_min({{'l': l, 'r': r, 'n': n}}, {{'m': -n, 'l': l, 'r': r}}) FROM (
      SELECT y[i] AS l, y[i + 1] AS r, CAST(sum(f) AS BIGINT) AS n FROM (
        SELECT f, y, unnest(range(1, len(y))) AS i FROM (SELECT f, string_split(substr(x, 2, length(x) - 2), chr(2) || chr(1)) AS y FROM (SELECT unnest(ws) AS x, unnest(fs) AS f))) GROUP BY 1, 2)) AS b
    FROM step WHERE k < {MERGES}) WHERE b IS NOT NULL),
rules AS (SELECT CAST(k - 1 AS INTEGER) AS rank, l, r, n FROM step WHERE k > 0),
{_TOKENS}"""


def _fold(symbols_: str, words_: str) -> str:
    """Encodings of words_ (word) by folding over the rules."""
    return f"""
e AS (SELECT word, string_split(substr(z, 2, length(z) - 2), chr(2) || chr(1)) AS tokens FROM (
  SELECT word, list_reduce(list_concat([chr(1) || array_to_string({symbols_}, chr(2) || chr(1)) || chr(2)],
    coalesce((SELECT list(chr(1) || l || chr(2) || chr(1) || r || chr(2) || chr(3) || chr(1) || l || r || chr(2) ORDER BY rank) FROM rules), [])),
    lambda a, x: replace(a, split_part(x, chr(3), 1), split_part(x, chr(3), 2))) AS z FROM {words_})),
"""


_DOCS = f"""
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{_PAT}') AS ws FROM documents)),
d AS (SELECT doc_id, flatten(list(tokens ORDER BY pos)) AS tokens FROM o JOIN e ON o.word = e.word GROUP BY doc_id),
dt AS (SELECT documents.doc_id, coalesce(d.tokens, []) AS tokens FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id)
"""


def _learned(merges: int) -> str:
    """As _with for many rules: a table of words, pairs and rules, where a step changes the words that hold its pair, and their pairs' counts.
    Then e, the encodings of all words by rank: of rules given twice the later rank holds, and a step merges one place of a word."""
    return f"""{_pairs()}
t(kind, key, z, n, l, r) USING KEY (kind, key) AS (
  SELECT * FROM (
    SELECT 'word' AS kind, word AS key, chr(1) || array_to_string(symbols, chr(2) || chr(1)) || chr(2) AS z, freq AS n, CAST(NULL AS VARCHAR) AS l, CAST(NULL AS VARCHAR) AS r FROM s
    UNION ALL SELECT 'pair', l || chr(2) || r, NULL, n, l, r FROM pc
    UNION ALL SELECT 'step', '', NULL, 0, NULL, NULL)
  UNION
  (WITH k AS MATERIALIZED (SELECT n AS k FROM t WHERE kind = 'step' AND n < {merges}),
    best AS MATERIALIZED (SELECT k, b.l, b.r, b.n, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2) AS a, chr(1) || b.l || b.r || chr(2) AS ab FROM
      (SELECT arg_min({{'l': l, 'r': r, 'n': n}}, {{'m': -n, 'l': l, 'r': r}}) AS b FROM recurring.t WHERE kind = 'pair' AND n > 0), k WHERE b IS NOT NULL),
    hit AS MATERIALIZED (SELECT x.key, x.z, x.n, replace(x.z, a, ab) AS after FROM recurring.t x, best WHERE x.kind = 'word' AND contains(x.z, a)),
    delta AS MATERIALIZED (SELECT l || chr(2) || r AS key, l, r, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT n, y[i] AS l, y[i + 1] AS r FROM (SELECT n, y, unnest(range(1, len(y))) AS i FROM (SELECT n, string_split(substr(z, 2, length(z) - 2), chr(2) || chr(1)) AS y FROM (
        SELECT -n AS n, z FROM hit UNION ALL SELECT n, after FROM hit)))) GROUP BY l, r)
   SELECT 'word', key, after, n, NULL, NULL FROM hit
   UNION ALL SELECT 'pair', delta.key, NULL, delta.n + coalesce(x.n, 0), delta.l, delta.r FROM delta LEFT JOIN (SELECT key, n FROM recurring.t WHERE kind = 'pair') x ON x.key = delta.key
   UNION ALL SELECT 'rule', CAST(k AS VARCHAR), NULL, n, l, r FROM best
   UNION ALL SELECT 'step', '', NULL, k + 1, NULL, NULL FROM best)),
rules AS MATERIALIZED (SELECT CAST(key AS INTEGER) AS rank, l, r, n FROM t WHERE kind = 'rule'),
ranks AS MATERIALIZED (SELECT l, r, max(rank) AS rank FROM rules GROUP BY l, r),
coded(k, word, y) AS (
  SELECT 0, word, symbols FROM s
  UNION ALL
  SELECT k + 1, word, list_concat(y[1:i - 1], [y[i] || y[i + 1]], y[i + 2:]) FROM (
    SELECT any_value(k) AS k, word, any_value(y) AS y, arg_min(i, {{'rank': rank, 'i': i}}) AS i
    FROM (SELECT k, word, y, i, y[i] AS l, y[i + 1] AS r FROM (SELECT k, word, y, unnest(range(1, len(y))) AS i FROM coded)) x JOIN ranks ON ranks.l = x.l AND ranks.r = x.r GROUP BY word)),
e AS (SELECT word, arg_max(y, k) AS tokens FROM coded GROUP BY word),
{_TOKENS}"""


def _production(tail: str, more: str = "") -> str:
    return "WITH RECURSIVE " + (_learned(PRODUCTION) + more).rstrip().rstrip(",") + "\n" + tail


def _sql(tail: str, where: str = "", more: str = "") -> str:
    return "WITH RECURSIVE " + (_with(where) + more).rstrip().rstrip(",") + "\n" + tail


_ALL = _fold(_SYMBOLS, "w")
_ENCODED = _sql("SELECT word, array_to_string(tokens, ' ') AS tokens FROM e", more=_ALL)
_SIZED = "SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM dt"
_TEXTS = _sql(_SIZED, more=_ALL + _DOCS)
_FR = f"fr AS (SELECT word, (SELECT list(symbol) FROM al) AS known FROM ({_words('''WHERE lang = 'fr' ''')})),"
_CHARS = "[substr(word, i, 1) for i in range(1, length(word) + 1)]"
_KNOWN = "list_contains(known, c)"
_OOV = "SELECT word, array_to_string(tokens, ' ') AS tokens FROM e"
_IDS = "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, md5(array_to_string(ids, ' ')) AS ids_md5 FROM (SELECT dt.doc_id, coalesce(x.ids, []) AS ids FROM dt LEFT JOIN x ON dt.doc_id = x.doc_id)"


def _numbered(vocab: str) -> str:
    return f""", u AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM dt),
x AS (SELECT doc_id, list(CAST(coalesce(v.id, 3) AS VARCHAR) ORDER BY pos) AS ids FROM u LEFT JOIN {vocab} v ON u.token = v.token GROUP BY doc_id)
"""


_EN = f"(SELECT symbol AS token, CAST(row_number() OVER (ORDER BY symbol) + 3 AS INTEGER) AS id FROM (SELECT DISTINCT unnest({_CHARS}) AS symbol FROM ({_words('''WHERE lang = 'en' ''')})))"
_RULES = _sql("SELECT rank, l, r FROM rules")

SQL = {
    "word_counts": _words(),
    "word_counts_by_lang": f"SELECT lang, word, CAST(count(*) AS BIGINT) AS freq FROM (SELECT lang, unnest(regexp_extract_all(text, '{_PAT}')) AS word FROM documents) GROUP BY lang, word",
    "distinct_words": f"SELECT word FROM ({_words()})",
    "alphabet": _sql("SELECT symbol FROM al"),
    "segmented_words": _sql("SELECT word, freq, array_to_string(symbols, ' ') AS segmented FROM s"),
    "pair_counts": _sql("SELECT l, r, n FROM pc"),
    "pair_counts_lead": _sql("SELECT l, r, n FROM pc"),
    "top_pair": _sql("SELECT l, r, n FROM pc ORDER BY n DESC, l, r LIMIT 1"),
    "top_pairs_k": _sql(f"SELECT l, r, n FROM pc ORDER BY n DESC, l, r LIMIT {TOP}"),
    "pair_postings": _sql("SELECT l, r, CAST(count(DISTINCT word) AS BIGINT) AS n_words, md5(string_agg(DISTINCT word, ' ' ORDER BY word)) AS words_md5 FROM p GROUP BY l, r"),
    "words_of_pairs": _sql("SELECT DISTINCT p.l, p.r, p.word FROM p JOIN best ON p.l = best.l AND p.r = best.r", more=f"best AS MATERIALIZED (SELECT l, r FROM pc ORDER BY n DESC, l, r LIMIT {TOP}),"),
    "merge_once": f"""WITH {_pairs()} x AS MATERIALIZED (SELECT chr(1) || l || chr(2) || chr(1) || r || chr(2) AS a, chr(1) || l || r || chr(2) AS b FROM pc ORDER BY n DESC, l, r LIMIT 1)
SELECT word, freq, replace(replace(replace(replace(chr(1) || array_to_string(symbols, chr(2) || chr(1)) || chr(2), (SELECT a FROM x), (SELECT b FROM x)), chr(2) || chr(1), ' '), chr(1), ''), chr(2), '') AS merged FROM s""",
    "bpe_train_rules": _sql("SELECT rank, l, r, n FROM rules"),
    "bpe_train_kernel": _sql("SELECT rank, l, r, n FROM rules"),
    "bpe_train_by_lang": "",
    "token_set": _sql("SELECT token FROM ts"),
    "rule_ranks": _sql(f"SELECT CAST(max(rank) AS INTEGER) AS rank, l, r FROM (SELECT l, r, unnest(CASE WHEN k < 5 THEN [k, k + {TOP}] ELSE [k] END) AS rank FROM (SELECT l, r, row_number() OVER (ORDER BY n DESC, l, r) - 1 AS k FROM pc) WHERE k < {TOP}) GROUP BY l, r"),
    "encode_words_sweep": _ENCODED,
    "encode_words_rank": _ENCODED,
    "encode_documents": _TEXTS,
    "encode_documents_join": _TEXTS,
    "encode_documents_cached": _production(_SIZED, _DOCS),
    "encoding_cache": _production(
        "SELECT e.word, array_to_string(e.tokens, ' ') AS tokens, f.lang FROM e JOIN f ON e.word = f.word",
        f"f AS (SELECT word, min(lang) AS lang FROM (SELECT lang, unnest(regexp_extract_all(text, '{_PAT}')) AS word FROM documents) GROUP BY word),",
    ),
    "encode_stream": _TEXTS,
    "token_freq": _sql("SELECT token, CAST(sum(freq) AS BIGINT) AS n FROM (SELECT w.freq, unnest(e.tokens) AS token FROM e JOIN w ON e.word = w.word) GROUP BY token", more=_ALL),
    "encode_oov_replace": _sql(_OOV, "WHERE lang = 'en'", _FR + _fold(f"list_concat([CASE WHEN {_KNOWN} THEN c ELSE '{UNKNOWN}' END for c in {_CHARS}], ['{WORD_END}'])", "fr")),
    "encode_oov_drop": _sql(_OOV, "WHERE lang = 'en'", _FR + _fold(f"list_concat([c for c in {_CHARS} if {_KNOWN}], ['{WORD_END}'])", "fr")),
    "uncached_words": f"SELECT word FROM ({_words('''WHERE lang = 'fr' ''')}) WHERE word NOT IN (SELECT word FROM ({_words('''WHERE lang = 'en' ''')}))",
    "encodings_upsert": f"SELECT coalesce(a.word, b.word) AS word, CASE WHEN b.word IS NULL THEN 'cache' ELSE 'worker' END AS origin FROM ({_words('''WHERE lang = 'en' ''')}) a FULL JOIN ({_words('''WHERE lang = 'fr' ''')}) b ON a.word = b.word",
    "vocab_ids": _sql("SELECT token, id FROM vocab"),
    "vocab_add_tokens": _sql(f"SELECT token, CAST(CASE WHEN id IS NOT NULL THEN id ELSE (SELECT max(id) FROM {_EN}) + row_number() OVER (PARTITION BY id IS NULL ORDER BY token) END AS INTEGER) AS id FROM (SELECT al.symbol AS token, v.id FROM al LEFT JOIN {_EN} v ON al.symbol = v.token)"),
    "token_ids": _sql(_IDS, more=_ALL + _DOCS + _numbered(_EN)),
    "token_ids_strict": _production(_IDS, _DOCS + _numbered("vocab")),
    "model_json_roundtrip": _RULES,
    "model_json_legacy": _sql(f"SELECT token, '{UNKNOWN}' AS unknown, '{WORD_END}' AS word_end FROM ts"),
    "model_tables_roundtrip": _RULES,
}
_BY_LANG = ("en", "fr", "de", "es")
SQL["bpe_train_by_lang"] = " UNION ALL ".join(f"SELECT * FROM ({_sql(f'''SELECT '{x}' AS lang, rank, l, r, n FROM rules''', f'''WHERE lang = '{x}' ''')})" for x in _BY_LANG)
