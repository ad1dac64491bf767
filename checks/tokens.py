"""Vocabularies and token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, texts
from moltable.operators import tokens as tk
from moltable.operators import vocab as vc
from moltable.runtime import new_path

WORDS = r"regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+')"
PIECES = r"regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')"
VOCAB = 2000
UNK, PAD, CLS, SEP, MASK = range(5)
MAX_LENGTH, BATCH = 256, 64

WORD_SQL = f"SELECT doc_id, unnest({WORDS}) AS token, unnest(range(len({WORDS}))) AS pos FROM documents"
VOCAB_SQL = f"""
    SELECT (row_number() OVER (ORDER BY n DESC, token) + 4)::INTEGER AS id, token
    FROM (SELECT token, count(*) AS n FROM ({WORD_SQL}) GROUP BY token ORDER BY n DESC, token LIMIT {VOCAB - 5})
    UNION ALL SELECT * FROM (VALUES (0, '[UNK]'), (1, '[PAD]'), (2, '[CLS]'), (3, '[SEP]'), (4, '[MASK]'))
"""
IDS_SQL = f"SELECT doc_id, pos, coalesce(id, {UNK}) AS id FROM ({WORD_SQL}) w LEFT JOIN ({VOCAB_SQL}) v USING (token)"
# Between [CLS] and [SEP]: whole texts, and truncated ones for the queries of a fixed length.
WHOLE_SQL = f"""
    SELECT doc_id, pos + 1 AS pos, id FROM ({IDS_SQL})
    UNION ALL SELECT doc_id, 0, {CLS} FROM documents
    UNION ALL SELECT doc_id, len({WORDS}) + 1, {SEP} FROM documents
"""
FRAMED_SQL = f"""
    SELECT doc_id, pos + 1 AS pos, id FROM ({IDS_SQL}) WHERE pos < {MAX_LENGTH - 2}
    UNION ALL SELECT doc_id, 0, {CLS} FROM documents
    UNION ALL SELECT doc_id, least(len({WORDS}), {MAX_LENGTH - 2}) + 1, {SEP} FROM documents
"""


def _word_vocabulary(spark, sf_dir):
    counts = vc.piece_counts(texts(spark, sf_dir), vc.words(F.col("text")))
    return vc.word_vocabulary(counts, VOCAB)


def _encoded(spark, sf_dir):
    return tk.encode_words(texts(spark, sf_dir), vc.words(F.col("text")), _word_vocabulary(spark, sf_dir))


def _framed(spark, sf_dir):
    cut = tk.truncate(F.col("ids"), MAX_LENGTH)
    return _encoded(spark, sf_dir).select("doc_id", tk.template_single(cut, CLS, SEP).alias("ids"))


def _whole(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", tk.template_single(F.col("ids"), CLS, SEP).alias("ids"))


def _checksum(ids):
    """Length, sum and place-weighted sum of an array, as columns."""
    weighted = F.transform(ids, lambda x, i: x.cast("bigint") * (i + 1))
    total = F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.size(ids).alias("n"), total.alias("checksum")


CHECKSUM_SQL = "count(*) AS n, sum(id * (pos + 1))::BIGINT AS checksum"


@check("tok_pretokenize", f"SELECT doc_id, count(*) AS n, sum(strlen(trim(p)))::BIGINT AS n_bytes FROM (SELECT doc_id, unnest({PIECES}) AS p FROM documents) WHERE p NOT SIMILAR TO '\\s*' GROUP BY doc_id")
def tok_pretokenize(spark, sf_dir):
    # A leading space is one character of the byte alphabet; pieces of white space only are left out here.
    docs = texts(spark, sf_dir)
    blank = "^[ĠĊčĉ]*$"
    pieces = docs.select("doc_id", F.explode(vc.pretokenize(F.col("text"))).alias("p")).where(~F.col("p").rlike(blank))
    return pieces.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.length(F.regexp_replace("p", "^Ġ", ""))).alias("n_bytes")
    )


@check("tok_wordcount", f"SELECT trim(p) AS piece, count(*) AS n FROM (SELECT unnest({PIECES}) AS p FROM documents) WHERE p NOT SIMILAR TO '\\s*' GROUP BY 1")
def tok_wordcount(spark, sf_dir):
    counts = vc.piece_counts(texts(spark, sf_dir), vc.raw_pieces(F.col("text")))
    trimmed = counts.select(F.trim("piece").alias("piece"), "n").where(~F.col("piece").rlike(r"^\s*$"))
    return trimmed.groupBy("piece").agg(F.sum("n").alias("n"))


@check(
    "tok_pair_counts",
    f"""
    SELECT s[i] AS "left", s[i + 1] AS "right", sum(n)::BIGINT AS n
    FROM (SELECT s, n, unnest(range(1, len(s))) AS i
          FROM (SELECT regexp_extract_all(token, '(?s).') AS s, count(*) AS n FROM ({WORD_SQL}) GROUP BY token))
    GROUP BY ALL
    """,
)
def tok_pair_counts(spark, sf_dir):
    counts = vc.piece_counts(texts(spark, sf_dir), vc.words(F.col("text")))
    return vc.pair_counts(counts, F.col("piece"))


# Training is a loop over the whole table; it is compared with a public trainer in the tests.
@check("tok_train_bpe")
def tok_train_bpe(spark, sf_dir):
    return vc.train_bpe(vc.byte_piece_counts(texts(spark, sf_dir), "text")).merge_table(spark)


FIRST_MERGES = 10
MERGED_FROM = 0xF0000  # in the SQL a merged symbol is one character from here up, a letter stands for itself


def _train_sql() -> str:
    """The first merges over words, one by one: count all pairs, take the best, replace it everywhere."""
    steps = [f"w0 AS MATERIALIZED (SELECT token AS piece, count(*) AS n FROM ({WORD_SQL}) GROUP BY token)"]
    rows = []
    for k in range(FIRST_MERGES):
        cut = f"SELECT regexp_extract_all(piece, '(?s).') AS s, n FROM w{k}"
        steps.append(
            f"p{k} AS MATERIALIZED (SELECT s[i] || s[i + 1] AS pair FROM (SELECT s, n, unnest(range(1, len(s))) AS i FROM ({cut})) "
            f"GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 1)"
        )
        steps.append(
            f"w{k + 1} AS MATERIALIZED (SELECT replace(piece, (SELECT pair FROM p{k}), chr({MERGED_FROM + k})) AS piece, n FROM w{k})"
        )
        left, right = (f"(SELECT regexp_extract_all(pair, '(?s).')[{i}] FROM p{k})" for i in (1, 2))
        for j in reversed(range(k)):
            left, right = (f"replace({x}, chr({MERGED_FROM + j}), (SELECT pair FROM p{j}))" for x in (left, right))
        rows.append(f'SELECT {k} AS rank, {left} AS "left", {right} AS "right"')
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(rows)}"


@check("tok_train_bpe_first", _train_sql())
def tok_train_bpe_first(spark, sf_dir):
    counts = vc.piece_counts(texts(spark, sf_dir), vc.words(F.col("text")))
    letters = counts.select(F.explode(F.split("piece", "")).alias("c")).where("c <> ''").distinct().count()
    return vc.train_bpe(counts, len(vc.SPECIAL_TOKENS) + letters + FIRST_MERGES).merge_table(spark)


MERGES = [("t", "h"), ("th", "e"), ("e", "n"), ("i", "n"), ("in", "g"), ("o", "u"), ("e", "r"), ("d", "e"), ("c", "h"), ("en", "t")]


def _bpe_sql() -> str:
    """Letters in brackets, merged in rank order; what is left of each token is counted."""
    coded = r"regexp_replace(text, '([a-z])', chr(1) || '\1' || chr(2), 'g')"
    for a, b in MERGES:
        coded = f"replace({coded}, chr(1) || '{a}' || chr(2) || chr(1) || '{b}' || chr(2), chr(1) || '{a + b}' || chr(2))"
    names = [a + b for a, b in MERGES]
    counts = [f"(strlen(c) - strlen(replace(c, chr(1) || '{t}' || chr(2), ''))) // {len(t) + 2}" for t in names]
    listed = ", ".join(f"{k} AS k{i}" for i, k in enumerate(counts))
    saved = " + ".join(f"k{i} * {len(t) - 1}" for i, t in enumerate(names))
    merged = " + ".join(f"k{i}" for i in range(len(names)))
    weighted = " + ".join(f"k{i} * {5 + 256 + i}" for i in range(len(names)))
    return f"""
    SELECT doc_id, bytes - ({saved}) AS n, {merged} AS n_merged, {weighted} AS sum_merged
    FROM (SELECT doc_id, strlen(text) AS bytes, {listed} FROM (SELECT doc_id, text, {coded} AS c FROM documents))
    """


# Whole texts under a vocabulary trained on them; compared with a public tokenizer in the tests.
@check("tok_encode_bpe_trained")
def tok_encode_bpe_trained(spark, sf_dir):
    docs = texts(spark, sf_dir)
    vocab = vc.train_bpe(vc.byte_piece_counts(docs, "text"))
    return tk.encode_bpe(docs, "text", vocab).select("doc_id", *_checksum(F.col("ids")))


@check("tok_encode_bpe", _bpe_sql())
def tok_encode_bpe(spark, sf_dir):
    letters = sorted(vc.byte_alphabet().values())
    vocab = vc.Vocabulary([*vc.SPECIAL_TOKENS, *letters, *[a + b for a, b in MERGES]], MERGES)
    encoded = tk.encode_bpe(texts(spark, sf_dir), "text", vocab)
    merged = F.filter("ids", lambda x: x >= len(vc.SPECIAL_TOKENS) + len(letters))
    total = F.aggregate(merged, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return encoded.select("doc_id", F.size("ids").alias("n"), F.size(merged).alias("n_merged"), total.alias("sum_merged"))


@check("tok_from_vocab", VOCAB_SQL)
def tok_from_vocab(spark, sf_dir):
    folder = new_path(spark, "vocabulary")
    vc.write_vocabulary(spark, _word_vocabulary(spark, sf_dir), folder)
    return vc.read_vocabulary(spark, folder).token_table(spark)


@check("tok_vocabulary", VOCAB_SQL)
def tok_vocabulary(spark, sf_dir):
    return _word_vocabulary(spark, sf_dir).token_table(spark)


@check("tok_check_special", f"SELECT token, id FROM ({VOCAB_SQL}) WHERE id < 5")
def tok_check_special(spark, sf_dir):
    return vc.check_special(_word_vocabulary(spark, sf_dir).token_table(spark))


@check("tok_encode", f"SELECT doc_id, {CHECKSUM_SQL} FROM ({IDS_SQL}) GROUP BY doc_id")
def tok_encode(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", *_checksum(F.col("ids")))


@check("tok_truncate", f"SELECT doc_id, {CHECKSUM_SQL} FROM ({IDS_SQL}) WHERE pos < {MAX_LENGTH - 2} GROUP BY doc_id")
def tok_truncate(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", *_checksum(tk.truncate(F.col("ids"), MAX_LENGTH)))


@check("tok_template", f"SELECT doc_id, {CHECKSUM_SQL} FROM ({WHOLE_SQL}) GROUP BY doc_id")
def tok_template(spark, sf_dir):
    return _whole(spark, sf_dir).select("doc_id", *_checksum(F.col("ids")))


@check(
    "tok_template_pair",
    f"""
    WITH a AS (SELECT doc_id, pos, id, max(pos) OVER (PARTITION BY doc_id) + 1 AS k FROM ({IDS_SQL})),
         f AS (SELECT doc_id, pos + 1 AS pos, id FROM a UNION ALL SELECT doc_id, pos + k + 2, id FROM a
               UNION ALL SELECT doc_id, 0, {CLS} FROM documents
               UNION ALL SELECT doc_id, len({WORDS}) + 1, {SEP} FROM documents
               UNION ALL SELECT doc_id, 2 * len({WORDS}) + 2, {SEP} FROM documents)
    SELECT doc_id, {CHECKSUM_SQL} FROM f GROUP BY doc_id
    """,
)
def tok_template_pair(spark, sf_dir):
    ids = F.col("ids")
    return _encoded(spark, sf_dir).select("doc_id", *_checksum(tk.template_pair(ids, ids, CLS, SEP)))


PAD_SQL = f"SELECT doc_id // {BATCH} AS b, (ceil(max(len({WORDS}) + 2) / 8) * 8)::INTEGER AS pad_len FROM documents GROUP BY 1"


@check(
    "tok_pad_batch",
    f"""
    SELECT doc_id, pad_len, pad_len AS n,
           (checksum + {PAD} * (pad_len * (pad_len + 1) // 2 - k * (k + 1) // 2))::BIGINT AS checksum
    FROM (SELECT doc_id, count(*) AS k, sum(id * (pos + 1)) AS checksum FROM ({WHOLE_SQL}) GROUP BY doc_id)
    JOIN ({PAD_SQL}) ON b = doc_id // {BATCH}
    """,
)
def tok_pad_batch(spark, sf_dir):
    padded = tk.with_batch_length(_whole(spark, sf_dir), "ids", BATCH, "doc_id")
    return padded.select("doc_id", "pad_len", *_checksum(tk.pad_to(F.col("ids"), F.col("pad_len"), PAD)))


BUCKET_SQL = f"""
    SELECT doc_id, k, batch, max(size) OVER (PARTITION BY batch) AS pad_len
    FROM (SELECT *, (row_number() OVER (ORDER BY size, doc_id) - 1) // {BATCH} AS batch
          FROM (SELECT doc_id, len({WORDS}) + 2 AS k, (ceil((len({WORDS}) + 2) / 8) * 8)::INTEGER AS size FROM documents))
"""


@check("tok_pad_bucketed", f"SELECT doc_id, batch, pad_len FROM ({BUCKET_SQL})")
def tok_pad_bucketed(spark, sf_dir):
    return tk.bucketed_batches(_whole(spark, sf_dir), "ids", BATCH, "doc_id").select("doc_id", "batch", "pad_len")


@check(
    "tok_padding_share",
    f"""
    SELECT 'bucketed' AS how, round(1 - sum(k) / sum(pad_len), 6) AS share FROM ({BUCKET_SQL})
    UNION ALL SELECT 'consecutive', round(1 - sum(len({WORDS}) + 2) / sum(pad_len), 6) FROM documents JOIN ({PAD_SQL}) ON b = doc_id // {BATCH}
    """,
)
def tok_padding_share(spark, sf_dir):
    whole = _whole(spark, sf_dir)
    batched = {
        "bucketed": tk.bucketed_batches(whole, "ids", BATCH, "doc_id"),
        "consecutive": tk.with_batch_length(whole, "ids", BATCH, "doc_id"),
    }
    shares = [tk.padding_share(df, "ids").select(F.lit(how).alias("how"), F.round("share", 6).alias("share")) for how, df in batched.items()]
    return shares[0].unionByName(shares[1])


@check(
    "tok_pad_max",
    f"""
    SELECT doc_id, {MAX_LENGTH} AS n,
           (sum(id * (pos + 1)) + {PAD} * ({MAX_LENGTH * (MAX_LENGTH + 1) // 2} - count(*) * (count(*) + 1) // 2))::BIGINT AS checksum
    FROM ({FRAMED_SQL}) GROUP BY doc_id
    """,
)
def tok_pad_max(spark, sf_dir):
    return _framed(spark, sf_dir).select("doc_id", *_checksum(tk.pad_to(F.col("ids"), MAX_LENGTH, PAD)))


@check(
    "tok_masks",
    f"""
    SELECT doc_id, n AS n_attended, m AS n_mask, (n * (n + 1) // 2)::BIGINT AS attended_places,
           (special + m * (m + 1) // 2 - n * (n + 1) // 2)::BIGINT AS special_places
    FROM (SELECT doc_id, count(*) AS n, (ceil(count(*) / 8) * 8)::INTEGER AS m, sum((id < 5)::INTEGER * (pos + 1)) AS special
          FROM ({WHOLE_SQL}) GROUP BY doc_id)
    """,
)
def tok_masks(spark, sf_dir):
    length = tk.round_up(F.size("ids"))
    attention = tk.attention_mask(F.col("ids"), length)
    special = tk.special_mask(tk.pad_to(F.col("ids"), length, PAD), [UNK, PAD, CLS, SEP, MASK])
    attended = F.aggregate(attention, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _whole(spark, sf_dir).select(
        "doc_id", attended.alias("n_attended"), F.size(attention).alias("n_mask"),
        _checksum(attention)[1].alias("attended_places"), _checksum(special)[1].alias("special_places"),
    )


MLM_SQL = f"""
    SELECT doc_id, pos, CASE WHEN NOT chosen THEN id WHEN w < 0.8::DOUBLE THEN {MASK}
                             WHEN w < 0.8::DOUBLE + 0.1::DOUBLE
                             THEN least(floor((w - 0.8::DOUBLE) / 0.1::DOUBLE * {VOCAB})::INTEGER, {VOCAB - 1}) ELSE id END AS input_id,
           CASE WHEN chosen THEN id ELSE -100 END AS label
    FROM (SELECT doc_id, pos, id, u < 0.3::DOUBLE AND id >= 5 AS chosen, u / 0.3::DOUBLE AS w
          FROM (SELECT *, ('0x' || substr(md5('9-' || doc_id || '-' || pos // 4), (1 + 8 * (pos % 4))::BIGINT, 8))::BIGINT
                          / 4294967296.0::DOUBLE AS u FROM ({WHOLE_SQL})))
"""


def _masked(spark, sf_dir):
    cells = tk.mlm_mask("doc_id", F.col("ids"), [UNK, PAD, CLS, SEP, MASK], MASK, VOCAB, 9)
    return _whole(spark, sf_dir).select("doc_id", cells.alias("cells"))


@check(
    "tok_mlm_mask",
    f"""
    SELECT doc_id, count(*) AS n, sum(input_id * (pos + 1))::BIGINT AS checksum, sum(label * (pos + 1))::BIGINT AS label_checksum
    FROM ({MLM_SQL}) GROUP BY doc_id
    """,
)
def tok_mlm_mask(spark, sf_dir):
    n, checksum = _checksum(F.col("cells.input_id"))
    return _masked(spark, sf_dir).select("doc_id", n, checksum, _checksum(F.col("cells.label"))[1].alias("label_checksum"))


@check("tok_sparse_filter", f"SELECT doc_id, pos::INTEGER AS pos, input_id::INTEGER AS input_id, label::INTEGER AS label FROM ({MLM_SQL}) WHERE label <> -100")
def tok_sparse_filter(spark, sf_dir):
    return tk.loss_positions(_masked(spark, sf_dir), "doc_id", "cells")


@check(
    "tok_vocab_stats",
    f"""
    SELECT count(*) AS n_texts, sum(k)::BIGINT AS n_tokens, sum(u)::BIGINT AS n_unknown, median(k)::DOUBLE AS median_length,
           max(k) AS max_length, (SELECT count(DISTINCT id) FROM ({IDS_SQL})) AS n_distinct
    FROM (SELECT doc_id, count(*) AS k, sum((id = {UNK})::INTEGER) AS u FROM ({IDS_SQL}) GROUP BY doc_id)
    """,
)
def tok_vocab_stats(spark, sf_dir):
    return tk.vocabulary_report(_encoded(spark, sf_dir), "ids", UNK)


@check(
    "tok_usage",
    f"SELECT v.id, v.token, count(w.id) AS n FROM ({VOCAB_SQL}) v LEFT JOIN ({IDS_SQL}) w ON v.id = w.id GROUP BY v.id, v.token",
)
def tok_usage(spark, sf_dir):
    vocab = _word_vocabulary(spark, sf_dir)
    encoded = tk.encode_words(texts(spark, sf_dir), vc.words(F.col("text")), vocab)
    return tk.token_usage(encoded, "ids", vocab.token_table(spark))
