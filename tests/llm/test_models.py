"""Quality, toxicity, media, chats and the pipeline."""

import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.llm import chat_format, media_columns, packing, quality_lm, registry, repeat_removal, simhash_dedup, toxicity
from ratelens.llm.common import table

SF = "/root/testdata/sf0.001"


def test_forward_backward_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = np.random.default_rng(0)
    start, step = rng.standard_normal(2), rng.standard_normal((2, 2))
    sizes = [5, 1, 7]
    scores = rng.standard_normal(sum(sizes))
    heads = np.cumsum([0, *sizes[:-1]])
    got, pairs = toxicity.forward_backward(scores, heads, start, step, pairs=True)
    at = 0
    for n in sizes:
        total, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            w = math.exp(start[tags[0]] + sum(step[a, b] for a, b in zip(tags, tags[1:])) + sum(scores[at + i] for i, t in enumerate(tags) if t))
            total += w
            one += w * np.array(tags)
            for i in range(1, n):
                two[i, tags[i - 1], tags[i]] += w
        assert np.allclose(got[at : at + n], one / total)
        assert np.allclose(pairs[at + 1 : at + n], two[1:] / total)
        at += n


def toxic_corpus(n=400):
    rnd = random.Random(2)
    words = ["".join(rnd.choice(["la", "mi", "so", "te", "ru"]) for _ in range(3)) for _ in range(200)]
    texts, labels = [], []
    for i in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(rnd.randint(1, 3) if bad else 0):
            own.insert(rnd.randrange(len(own)), rnd.choice(["Grotzen", "grotzig", "BLARF"]))
        texts.append(" ".join(own) + ".")
        labels.append((i, 1, int(bad)))
    return texts, labels


def test_toxicity_held_out_accuracy_and_spans(spark, documents):
    texts, labels = toxic_corpus()
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents([*texts, None, "", "a" * 50_000], [*range(len(texts)), 1000, 1001, None]).withColumn("label", F.lit(1))
    rows = toxicity.toxicity(docs, said).collect()
    assert len(rows) == len(texts) + 3
    wrong = 0
    for r in rows:
        if r.doc_id is None or r.doc_id >= 1000:
            assert r.predicted == 0 and not r.spans
            continue
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        wrong += r.held_out and r.predicted != labels[r.doc_id][2]
        if r.predicted and labels[r.doc_id][2]:
            found = {w.lower() for s in r.spans for w in texts[r.doc_id][s.start : s.stop].split()}
            assert found & {"grotzen", "grotzig", "blarf"}
    assert wrong <= 2
    assert toxicity.clean_documents(docs, said).columns == docs.columns
    none = toxicity.toxicity(docs, said.limit(0)).collect()
    assert len(none) == len(rows) and all(0 <= r.score <= 1 for r in none)
    assert toxicity.toxicity(docs.limit(0), said).count() == 0


def test_held_out_labels_are_not_used(spark, documents):
    texts, labels = toxic_corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    scores = [{r.doc_id: r.score for r in toxicity.toxicity(documents(texts), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


WORD = re.compile(r"[^\W_]+|[^\w\s]+")


def plain_kneser_ney(texts):
    """p(word | context) of the same model by dictionaries; None stands for the end, "" for the start."""
    pairs = Counter()
    for t in texts:
        w = [*WORD.findall(t), None]
        pairs.update(zip(["", *w], w))
    ends = Counter(w for _, w in pairs)

    def off(counts):
        d = quality_lm.discounts(Counter(counts.values()))
        return lambda n: d[min(n, 3) - 1]

    off2, off1 = off(pairs), off(ends)
    total = sum(ends.values())
    p0 = sum(map(off1, ends.values())) / total / (len(ends) + 1)
    totals, left = Counter(), Counter()
    for (v, _), n in pairs.items():
        totals[v] += n
        left[v] += off2(n) if n >= quality_lm.LEAST else n

    def p(w, v):
        low = (ends[w] - off1(ends[w]) if ends[w] else 0) / total + p0
        if v not in totals:
            return low
        n = pairs[v, w]
        return (n - off2(n) if n >= quality_lm.LEAST else 0) / totals[v] + left[v] / totals[v] * low

    return p, set(ends)


def plain_losses(p, text):
    w = [*WORD.findall(text), None]
    both = list(zip(["", *w], w))
    return -sum(math.log(p(w, v)) for v, w in both), len(w), len(set(both))


TRAIN = ["the cat sat on the mat.", "The dog ran; the cat ran!", "on and on", "", "the cat ran on the mat.", "the cat ran. the dog sat on the cat"]


@pytest.mark.parametrize("segment", [1 << 20, 16])
def test_kneser_ney_equals_the_plain_model(spark, monkeypatch, segment):
    monkeypatch.setattr(quality_lm, "SEGMENT", segment)
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3)
    model, unknown = quality_lm.trained(train)
    p, known = plain_kneser_ney(TRAIN)
    assert math.exp(unknown) == pytest.approx(p("never", "never"))
    for v in ("", "the", "cat", "never"):
        assert sum(p(w, v) for w in known) + p("never", v) == pytest.approx(1)
    texts = [*TRAIN, "the cat", "zzz $$$ 99", "the the the the", "x" * 100 + " the cat sat on the mat. " * 9]
    rows = spark.createDataFrame([(i, 0, "en", t) for i, t in enumerate(texts)], "k1 long, k2 long, lang string, text string").repartition(3)
    for r in quality_lm.with_losses(rows, model, unknown).collect():
        loss, n, pairs = plain_losses(p, texts[r.k1])
        assert r.loss == pytest.approx(loss, rel=1e-5) and (r.n, r.pairs) == (n, pairs)


def test_words_of_scripts(spark):
    data = "ab,c 漢字x éa!? 한".encode()
    found, text = quality_lm.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    alone = [quality_lm.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0] for w in ("ab", ",", "c", "漢", "字", "x", "éa", "!?", "한")]
    assert found.tolist() == np.concatenate(alone).tolist() and set(text) == {0}


def test_quality_equals_the_plain_query(spark):
    """Scores and thresholds of the whole query against dictionaries."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    key = {r.doc_id: r.k1 for r in docs.select("doc_id", quality_lm.text_key(quality_lm.text_column())[0].alias("k1")).collect()}
    every = [(r.doc_id, r.lang, r.text or "") for r in docs.collect()]
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    aside = {d for d in key if (key[d] >> 8) % 100 < quality_lm.HELD_OUT}
    ascii_words = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+")
    globals()["WORD"], old = ascii_words, WORD
    try:
        p, _ = plain_kneser_ney([t for d, _, t in every if d in good - aside])
        losses = {d: plain_losses(p, t) for d, _, t in every}
    finally:
        globals()["WORD"] = old
    judges = [(d, lang) for d, lang, _ in every if d in good & aside]
    mean_all = sum(losses[d][0] for d, _ in judges) / sum(losses[d][1] for d, _ in judges)
    prior, extra = quality_lm.PRIOR, quality_lm.PRIOR_MEAN
    means = {}
    for lang in {x for _, x in judges}:
        own = [losses[d] for d, x in judges if x == lang]
        means[lang] = (sum(x[0] for x in own) + extra * mean_all) / (sum(x[1] for x in own) + extra)

    def figures(d, lang):
        loss, n, pairs = losses[d]
        mean = means.get(lang, mean_all)
        score = (loss + prior * mean) / (n + prior)
        return score, max(score, mean) * (pairs + prior) / (n + prior)

    def limits(own):
        apart = [sorted(x) for x in zip(*((s - means[x], e - means[x]) for d, x in own for s, e in [figures(d, x)]))]
        at = [max(1, math.ceil(q * len(own))) - 1 for q in (quality_lm.QUANTILE, 1 - quality_lm.QUANTILE)]
        return apart[0][at[0]], apart[1][at[1]]

    of_all = limits(judges)
    rows = {r.doc_id: r for r in quality_lm.quality(docs, labels).collect()}
    assert len(rows) == len(every)
    for d, lang, _ in every:
        own = [x for x in judges if x[1] == lang]
        share = len(own) / (len(own) + quality_lm.LANGUAGE_WEIGHT)
        high, low = (share * a + (1 - share) * b for a, b in zip(limits(own) if own else of_all, of_all))
        mean = means.get(lang, mean_all)
        highest, least = mean + high + quality_lm.MARGIN, (mean + low) * quality_lm.ENOUGH
        score, density = figures(d, lang)
        r = rows[d]
        assert (r.score, r.highest, r.density, r.least) == pytest.approx((score, highest, density, least), rel=1e-4)
        assert r.kept == (score <= highest and density >= least)


def test_quality_keeps_clean_and_rejects_junk(spark, documents):
    rnd = random.Random(8)
    stock = ["".join(rnd.choice(["ri", "ver", "sto", "ne", "hill"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    clean = [" ".join(rnd.choice(stock) for _ in range(60)) + "." for _ in range(200)]
    junk = [" ".join(rnd.choice("$#%&*XQ!") for _ in range(200)) for _ in range(10)] + [(w + " ") * 400 for w in stock[:10]]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(200, 0, 0), (None, 1, 0), (7, None, 0), (9999, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    own = ["score", "perplexity", "kept", "loss", "k1", "own_0", "id"]
    docs = documents([*clean, *junk, None, "", clean[0]], [*range(220), None, 500, 0]).withColumns({c: F.lit(c) for c in own})
    rows = quality_lm.quality(docs, labels).collect()
    assert len(rows) == 223
    kept = {r.doc_id for r in rows if r.kept}
    assert set(range(200)) <= kept and not kept & set(range(200, 220)) and {None, 500} <= kept
    left = quality_lm.trusted_like(docs, labels)
    assert left.columns == docs.columns and left.count() == 203 and all(r.score == "score" and r.own_0 == "own_0" for r in left.collect())
    assert quality_lm.quality(docs, labels.limit(0)).where("kept").count() == 223 and quality_lm.trusted_like(docs, labels.limit(0)).count() == 223
    assert quality_lm.quality(docs.limit(0), labels).count() == 0 and quality_lm.trusted_like(docs.limit(0), labels).count() == 0
    nowhere = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang for r in quality_lm.quality(nowhere, labels).collect()} == {None}


def test_media_formats_and_digests(documents, odd_texts):
    rng = np.random.default_rng(0)
    for channels, shape in ((1, (5, 7)), (3, (3, 64)), (1, (1, 1))):
        image = rng.integers(0, 256, (*shape, channels)).astype(np.uint8)
        assert (media_columns.decode(media_columns.encode_netpbm(image)) == image).all()
        assert (media_columns.decode(media_columns.encode_bmp(image)) == image).all()
        plain = np.kron(image.astype(float), np.ones((6, 4, 1)))
        small = media_columns.area_resized(plain, *shape)
        assert np.allclose(small, image)
    assert media_columns.decode(b"P2\n# note\n2 1\n9\n3 9\n")[0, :, 0].tolist() == [3, 9]
    assert media_columns.decode(b"P1 2 2 1 0 0 1")[:, :, 0].tolist() == [[0, 1], [1, 0]]
    assert media_columns.decode(b"P4\n9 1\n\x80\x00")[0, :, 0].tolist() == [0] + [1] * 8
    for broken in (b"P5\n4 4\n255\nab", b"xx", b"P5\n4 4\n0\n"):
        with pytest.raises(ValueError):
            media_columns.decode(broken)
    media = media_columns.stored_media(documents(odd_texts))
    for r in media_columns.media_digests(media).collect():
        payload = media_columns.payload_of((odd_texts[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) >= 64 and r.n_bytes == len((odd_texts[r.doc_id] or "").encode())
    assert media_columns.media_digests(media.limit(0)).count() == 0


#: Images without samples, with samples outside their range or of huge numbers.
BROKEN = [b"P5\n0 0\n255\n", b"P2 3 0 9 1 2 3", b"P2\n1 1\n255\n300", b"P2 1 1 255 -1", b"P2 1 1 9 99999999999999999999999", b"P5 1 1 9 \xff", b"P1 0 4 ", media_columns.encode_bmp(np.zeros((1, 1, 1), np.uint8)).replace((1).to_bytes(4, "little") * 2, (1).to_bytes(4, "little") + bytes(4), 1)]


def test_media_columns_of_any_image(spark):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (40, 30, 1)).astype(np.uint8), rng.integers(0, 256, (21, 50, 3)).astype(np.uint8)
    files = [media_columns.encode_netpbm(grey), media_columns.encode_bmp(grey), media_columns.encode_bmp(colour), b"BM", b"P5\n4 4\n255\nab", b"", None, *BROKEN]
    df = spark.createDataFrame(list(enumerate(files)), "n long, media binary").withColumns({"doc_id": F.lit(7), "kept": F.lit("x")})
    rows = {r.n: r for r in media_columns.with_decoded(df).collect()}
    assert [(r.rows, r.cols, r.channels) for r in (rows[0], rows[1], rows[2])] == [(40, 30, 1), (40, 30, 1), (21, 50, 3)]
    assert rows[0].tile == rows[1].tile and rows[0].dhash == rows[1].dhash and rows[0].kept == "x"
    assert all(rows[i].error and rows[i].tile is None for i in (3, 4, 5, *range(7, 7 + len(BROKEN)))) and rows[6].error is None and rows[6].tile is None
    for name in ("tile", "Rows", "error"):
        with pytest.raises(ValueError, match="already"):
            media_columns.with_decoded(df.withColumn(name, F.lit(1)))
    grid = media_columns.area_resized(colour.astype(float), 8, 9).mean(axis=2)
    plain = "".join("1" if round(float(grid[i, j + 1]), 6) > round(float(grid[i, j]), 6) else "0" for i in range(8) for j in range(8))
    assert rows[2].dhash == f"{int(plain, 2):016x}"
    side = media_columns.TILE
    tile = np.load(io.BytesIO(rows[0].tile))
    plain = np.zeros((side, side))
    for i in range(side):
        for j in range(side):
            area = [(min((i + 1) * 40 / side, y + 1) - max(i * 40 / side, y), min((j + 1) * 30 / side, x + 1) - max(j * 30 / side, x), grey[y, x, 0]) for y in range(40) for x in range(30) if y + 1 > i * 40 / side and y < (i + 1) * 40 / side and x + 1 > j * 30 / side and x < (j + 1) * 30 / side]
            plain[i, j] = sum(h * w * float(v) for h, w, v in area) / (40 * 30 / side / side)
    assert np.abs(tile.reshape(side, side) - plain).max() <= 0.5 + 1e-6
    assert media_columns.with_decoded(df.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, 2, None, None, None), (2, 2, b"xx", b"", "")], media_columns.MEDIA)
    assert {r.payload_sha256 for r in media_columns.media_digests(broken).collect()} == {None}


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|x|>", "a<\\\\|b", "<<||", "", "plain < | text"])
def test_escapes_are_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)
    formatted, loss, _ = chat_format.format_chat([(text + "\n\\n", [{"type": "text", "text": text}]), ("assistant", [{"text": text}])])
    assert chat_format.parse_chat(formatted) == [(text + "\n\\n", text), ("assistant", text)]
    assert [chat_format.unescape(formatted[a:b]) for a, b in loss] == [text]


def test_attachments(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,milliseconds:int,pages:int>"
    parts = [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 100, None), ("document", None, "c.pdf", None, None, None, 2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [])], f"conv_id long, turn int, role string, parts array<{part}>")
    odd = chat_format.formatted_chats(spark.createDataFrame([(1, 0, "user", [("video", None, None, 1, 1, None, None)])], df.schema), parts_col="parts").first()
    assert [(a.kind, a.ref, a.tokens) for a in odd.attachments] == [("other", "video", 1)] and "<|other:0|>" in odd.formatted
    row = chat_format.formatted_chats(df, parts_col="parts").first()
    assert [(a.number, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 3), (2, "document", "c.pdf", 512)]
    assert row.expanded_tokens == 519 and "see <\\|image:0|><|image:0|><|audio:1|><|document:2|>" in row.formatted


def test_chat_query_equals_its_sql(spark):
    from oracle import connection, difference

    assert difference(registry.op7_chat_formatting(spark, SF), connection(SF), registry.OP7_SQL) is None


def test_conversations_with_ties_nulls_and_clashing_columns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 5, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("content", F.lit(1)).withColumn("loss", F.lit(2))
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.formatted_chats(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest() and got[1].n_turns == 4
    assert (got[None].n_turns, got[None].loss_chars) == (1, 1)
    assert chat_format.formatted_chats(df.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage's decisions against plain versions, and the rows of run()."""
    import corpus_pipeline as pipeline
    from test_duplicates import plain_near, plain_removal, reached

    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(pipeline.STAGES)

    def after(name):
        out = stages[name](spark, docs, SF)
        assert out.columns == columns
        return spark.createDataFrame(out.collect(), docs.schema)

    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality_lm.quality(docs, table(spark, SF, "labels")).where("kept").collect()}  # itself held against dictionaries above
    docs = after("quality")
    assert sorted(map(tuple, docs.collect())) == sorted(tuple(rows[i]) for i in kept)
    field = toxicity.train(docs, table(spark, SF, "labels"))
    rows, clean = {r.doc_id: r for r in docs.collect()}, set()
    for i, r in rows.items():
        words, place, owner, _, _ = toxicity.tokens([r.text or ""])
        marginal = field.marginals(field.word_scores(words)[place], toxicity.heads_of(owner, place, words)) if len(place) else np.zeros(0)
        if toxicity.sigmoid(toxicity.document_inputs(marginal, owner, 1) @ field.document)[0] < 0.5:
            clean.add(i)
    docs = after("toxicity")
    assert sorted(map(tuple, docs.collect())) == sorted(tuple(rows[i]) for i in clean)
    every = sorted(docs.collect(), key=lambda r: r.doc_id)
    label = reached(len(every), plain_near([r.text for r in every], pipeline.NEAR_BITS, pipeline.NEAR_OF_WIDE))
    docs = after("simhash")
    assert sorted(map(tuple, docs.collect())) == sorted(tuple(r) for i, r in enumerate(every) if label[i] == i)
    every = sorted(docs.collect(), key=lambda r: r.doc_id)
    wanted = plain_removal([r.text for r in every])
    docs = after("repeats")
    left = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in left] == [r.doc_id for r in every]
    for r, before, (size, gone, _, digest) in zip(left, every, wanted):
        assert (r.text == before.text) == (gone == 0) and size - gone - 8 * 3 <= len((r.text or "").encode()) <= size - gone
        if len((r.text or "").encode()) == size - gone:
            assert hashlib.sha256((r.text or "").encode()).hexdigest() == digest
    packed = stages["packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left}
    ours = Counter((r.doc_id, r.doc_tokens) for r in packed)
    ran = pipeline.run(spark, SF).collect()
    assert set(ours) == {(r.doc_id, r.doc_tokens) for r in ran} and sum(r.length for r in packed) == sum(r.length for r in ran) == sum(n for _, n in ours)


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as pipeline

    names = ["score", "spans", "kept", "loss", "k1", "k2", "fp", "rows", "gram", "own_0", "component_id", "label"]
    docs = table(spark, SF, "documents").limit(60).withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= 60


def test_registered_names():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.queries()) == list(range(1, 14))
    assert {packing, repeat_removal, simhash_dedup} and set(registry.oracle_sql()) <= set(registry.queries())
