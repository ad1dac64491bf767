import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers, trainers

from moltable.operators import tokens as tk
from moltable.operators import vocab as vc

SPECIAL = vc.SPECIAL_TOKENS


def _public(texts, size):
    tokenizer = Tokenizer(models.BPE(unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.train_from_iterator(
        texts, trainers.BpeTrainer(vocab_size=size, min_frequency=2, special_tokens=SPECIAL, show_progress=False)
    )
    return tokenizer


ODD = ["", " ", "  a  b ", "don't  stop", "x\n\n y\t", "café 你好 12.5%", "a b", "''s 're we'll", "C[C@H](N)C(=O)O", "\U0001f600 ok"]


def test_pretokenize_like_the_public_one(spark, data):
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    ours = {r.i: r.p for r in df.select("i", vc.pretokenize(F.col("t")).alias("p")).collect()}
    public = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for i, text in enumerate(texts):
        assert ours[i] == [p for p, _ in public.pre_tokenize_str(text)], text[:80]


@pytest.fixture(scope="module")
def trained(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    public = _public(texts, 8192)
    return docs, texts, public, vc.train_bpe(vc.byte_piece_counts(docs, "text"))


def test_training_equals_the_public_trainer(trained):
    _, _, public, ours = trained
    assert len(ours.tokens) == 8192
    ids = public.get_vocab()
    assert sorted(ids, key=ids.get) == ours.tokens
    assert [tuple(m) for m in json.loads(public.to_str())["model"]["merges"]] == ours.merges


def test_training_takes_few_jobs(spark, trained):
    docs, *_ = trained
    spark.sparkContext.setJobGroup("training", "")
    merges = vc.train_bpe(vc.byte_piece_counts(docs, "text"), 2000).merges
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("training")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(merges) >= 20 * len(jobs)


def test_encoding_equals_the_public_one(spark, trained):
    docs, texts, public, ours = trained
    texts = texts + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r.ids for r in tk.encode_bpe(df, "t", ours).collect()}
    for i, text in enumerate(texts):
        assert got[i] == public.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("seed, max_chains", [(0, 5), (1, 5), (2, vc.MAX_CHAINS), (3, vc.MAX_CHAINS)])
def test_training_with_ties_and_repeats(spark, seed, max_chains):
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choice("ab" if seed % 2 else "abcd") for _ in range(rng.randint(1, 9))) for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    public = _public(texts, 45)
    ids = public.get_vocab()
    ours = vc.train_bpe(vc.byte_piece_counts(df, "t"), 45, max_chains=max_chains)
    assert sorted(ids, key=ids.get) == ours.tokens


def test_long_piece(spark):
    df = spark.createDataFrame([("ab" * 30_000,)], "t string")
    vocab = vc.Vocabulary([*SPECIAL, "a", "b", "ab", "abab"], [("a", "b"), ("ab", "ab")])
    assert tk.encode_bpe(df, "t", vocab).first().ids == [8] * 15_000


def test_min_frequency(spark):
    df = spark.createDataFrame([("xy",), ("zz",)], "t string")
    assert vc.train_bpe(vc.byte_piece_counts(df, "t"), 100).merges == []
    assert len(vc.train_bpe(vc.byte_piece_counts(df, "t"), 100, min_frequency=1).merges) == 2


def test_vocabulary_files(spark, tmp_path):
    vocab = vc.Vocabulary([*SPECIAL, "a", "b", "ab"], [("a", "b")])
    vc.write_vocabulary(spark, vocab, str(tmp_path))
    assert vc.read_vocabulary(spark, str(tmp_path)) == vocab
    parsed = vc.parse_vocabulary('{"a": 0, "b": 1, "ab": 2}', "#version: 0.2\na b\n")
    assert parsed == vc.Vocabulary(["a", "b", "ab"], [("a", "b")])


def test_special_tokens_must_exist(spark):
    assert vc.check_special(vc.Vocabulary([*SPECIAL, "a"]).token_table(spark)).count() == 5
    with pytest.raises(ValueError, match="MASK"):
        vc.check_special(vc.Vocabulary(SPECIAL[:4]).token_table(spark))


def _ids(spark, lengths):
    return spark.createDataFrame([(i, list(range(10, 10 + n))) for i, n in enumerate(lengths)], "row_idx bigint, ids array<int>")


def test_frames_and_padding(spark):
    df = _ids(spark, [0, 254, 255, 256, 3]).withColumn("ids", tk.template_single(tk.truncate(F.col("ids"), 256), 1, 2))
    sizes = {r.row_idx: (len(r.ids), r.ids[0], r.ids[-1]) for r in df.collect()}
    assert sizes == {0: (2, 1, 2), 1: (256, 1, 2), 2: (256, 1, 2), 3: (256, 1, 2), 4: (5, 1, 2)}
    padded = tk.with_batch_length(df, "ids", 2).withColumn("p", tk.pad_to(F.col("ids"), F.col("pad_len"), 3))
    assert {r.row_idx: (r.pad_len, len(r.p)) for r in padded.collect()} == {
        0: (256, 256), 1: (256, 256), 2: (256, 256), 3: (256, 256), 4: (8, 8)
    }
    masks = padded.where("row_idx = 4").select(
        tk.attention_mask(F.col("ids"), F.col("pad_len")).alias("a"), tk.special_mask(F.col("p"), [1, 2, 3]).alias("s")
    )
    assert tuple(masks.first()) == ([1, 1, 1, 1, 1, 0, 0, 0], [1, 0, 0, 0, 1, 1, 1, 1])


def test_masking_shares(spark):
    df = _ids(spark, [200] * 100)
    cells = tk.mlm_mask("row_idx", F.concat(F.array(F.lit(0)), "ids"), [0, 1, 2, 3, 4], 4, 500, 1)
    masked = df.select("row_idx", cells.alias("cells"))
    chosen = tk.loss_positions(masked, "row_idx", "cells")
    n = chosen.count()
    assert abs(n - 6000) < 3 * (20000 * 0.3 * 0.7) ** 0.5
    assert chosen.where("pos = 0").count() == 0
    to_mask, kept = chosen.where("input_id = 4").count() / n, chosen.where("input_id = label").count() / n
    assert to_mask == pytest.approx(0.8, abs=0.02) and kept == pytest.approx(0.1, abs=0.02)
    again = df.repartition(7).select("row_idx", cells.alias("cells"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, masked.collect()))


def test_words_encoding_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "q"), (4, None)], "i int, t string").coalesce(1)
    vocab = vc.word_vocabulary(vc.piece_counts(df.where("i < 3"), vc.words(F.col("t"))), 100)
    out = tk.encode_words(df, vc.words(F.col("t")), vocab)
    assert {r.i: r.ids for r in out.collect()} == {1: [5, 6, 5], 2: [], 3: [0], 4: []}
    bpe = tk.encode_bpe(df, "t", vc.Vocabulary([*SPECIAL, "a", "b", "Ġ"]))
    assert {r.i: r.ids for r in bpe.collect()} == {1: [5, 7, 6, 7, 5], 2: [], 3: [0], 4: []}


def test_trained_encoding_query(spark, data):
    import __spark_entry__ as entry

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    public = _public(texts.values(), 8192)
    got = {r.doc_id: (r.n, r.checksum) for r in entry.queries()["tok_encode_bpe_trained"](spark, data).collect()}
    want = {}
    for i, text in texts.items():
        ids = public.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), sum(x * (at + 1) for at, x in enumerate(ids)))
    assert got == want


def test_bucketed_batches(spark, monkeypatch):
    monkeypatch.setattr(tk, "BLOCK_ROWS", 7)
    lengths = [random.Random(1).choice([3, 3, 3, 9, 40, 200]) for _ in range(101)]
    got = {r.row_idx: r for r in tk.bucketed_batches(_ids(spark, lengths).repartition(4), "ids", 10).collect()}
    order = sorted(range(101), key=lambda i: (-(-lengths[i] // 8), i))
    for at, i in enumerate(order):
        batch = order[at // 10 * 10 : at // 10 * 10 + 10]
        assert (got[i].batch, got[i].pad_len, len(got[i].ids)) == (at // 10, max(-(-lengths[j] // 8) * 8 for j in batch), lengths[i])


def _slices_only(monkeypatch, limit):
    """Make ``_map_lists`` refuse more strings than ``limit`` in several rows at a time."""
    plain = tk._map_lists

    def guarded(lists, encode):
        assert len(lists) == 1 or len(lists.flatten()) <= limit
        return plain(lists, encode)

    monkeypatch.setattr(tk, "SLICE_STRINGS", limit)
    monkeypatch.setattr(tk, "_map_lists", guarded)


SLICED = ["a b a", "", None, "q a b a b a b a b", "b", "a", "b a"] * 20


def test_byte_pair_encoding_takes_slices_of_a_batch(spark, monkeypatch):
    _slices_only(monkeypatch, 5)
    df = spark.createDataFrame(list(enumerate(SLICED)), "i int, t string").coalesce(1)
    out = tk.encode_bpe(df, "t", vc.Vocabulary([*SPECIAL, "a", "b", "Ġ"]))
    id_of = {"a": 5, "b": 6, " ": 7}
    assert {r.i: r.ids for r in out.collect()} == {i: [id_of.get(c, 0) for c in t or ""] for i, t in enumerate(SLICED)}


def test_word_encoding_takes_slices_of_a_batch(spark, monkeypatch):
    _slices_only(monkeypatch, 5)
    df = spark.createDataFrame(list(enumerate(SLICED)), "i int, t string").coalesce(1)
    encoded = tk.encode_words(df, vc.words(F.col("t")), vc.Vocabulary([*SPECIAL, "a", "b"]))
    id_of = {"a": 5, "b": 6}
    want = [[id_of.get(c, 0) for c in (t or "").split()] for t in SLICED]
    assert {r.i: r.ids for r in encoded.collect()} == dict(enumerate(want))
    used = tk.token_usage(encoded, "ids", spark.createDataFrame([(5, "a"), (6, "b"), (9, "c")], "id int, token string"))
    assert {r.token: r.n for r in used.collect()} == {t: sum(w.count(i) for w in want) for i, t in ((5, "a"), (6, "b"), (9, "c"))}
    assert used._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    report = tk.vocabulary_report(encoded, "ids", 0).first()
    assert (report.n_texts, report.n_tokens, report.n_distinct) == (len(want), sum(map(len, want)), 3)


def test_masks_are_the_draws_of_the_digests_in_any_slices(spark, monkeypatch):
    monkeypatch.setattr(tk, "SLICE_STRINGS", 6)
    lists = [[7] * 9, [], None, [1, 8, None, 9, 10], [2], list(range(40))] * 3
    df = spark.createDataFrame([(None if i == 4 else i, x) for i, x in enumerate(lists)], "i int, ids array<int>").coalesce(1)
    made = df.select("i", tk.mlm_mask("i", F.col("ids"), [0, 1, 2], 4, 500, 9).alias("cells"))
    got = {r.i: r.cells for r in made.collect()}
    for i, ids in enumerate(lists):
        want = []
        for at, x in enumerate(ids or []):
            name = f"9-{at // 4}" if i == 4 else f"9-{i}-{at // 4}"
            draw = int(hashlib.md5(name.encode()).hexdigest()[8 * (at % 4) :][:8], 16) / 16**8
            within = draw / 0.3
            if x is None or x < 3 or draw >= 0.3:
                want.append((x, -100))
            else:
                want.append((4 if within < 0.8 else min(int((within - 0.8) / 0.1 * 500), 499) if within < 0.8 + 0.1 else x, x))
        cells = got[None if i == 4 else i]
        assert cells is None if ids is None else [tuple(c) for c in cells] == want


def test_loss_positions_make_the_cells_once(spark):
    df = spark.createDataFrame([(1, list(range(5, 60))), (2, []), (3, None)], "i int, ids array<int>")
    masked = df.select("i", tk.mlm_mask("i", F.col("ids"), [0], 4, 500, 1).alias("cells"))
    kept = tk.loss_positions(masked, "i", "cells")
    want = {(r.i, at, c.input_id, c.label) for r in masked.collect() for at, c in enumerate(r.cells or []) if c.label != -100}
    assert {tuple(r) for r in kept.collect()} == want and want
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(") == 1
