"""The operators of thicket.llm against brute force, and their defined edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("thicket.llm.queries")
from thicket.llm import bpe, chat, classifier, html, lm, media, mixing, quality_rules, simhash, urls  # noqa: E402
from thicket.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, "one two", "en", "a", 7, None), (3, "one two", "en", "a", 7, None), (None, "one two three four five", "xx", "b", 1, "y"), (5, "w " * 5000, "en", "b", 1, "y"), (6, "ab" * 40000, "de", "c", 1, "z"), (7, "中文 é́ <|endoftext|> don't", "zh", "c", 1, "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_bpe_joins_equal_whole():
    e = bpe.Encoder(bpe.public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(3)
    pool = ["a", "th", "e", " ", "\n", "'s", "!", "é", "́", "中", "1", "<|endoftext|>", "İ", "ing", "|", ",", "\U0001f600"]
    for _ in range(400):
        text = "".join(rng.choice(rng.sample(pool, 5)) for _ in range(rng.choice((3, 40, 200))))
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert list(e.encode(text, leaf=9)[0]) == want
        assert list(np.frombuffer(e.whole(text), "<u4")) == want


def test_bpe_query(spark, odd):
    e = bpe.Encoder(bpe.public_tokenizers.path(bpe.VOCABULARY))
    got = bpe.encode_digests(odd.select("doc_id", "text", "size")).collect()
    want = []
    for k, text, *_ in ODD:
        ids = e.tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(e.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_media_round_trip(spark, odd):
    got = {(r["doc_id"], r["payload_sha256"]) for r in media.media_columns(odd).collect()}
    assert got == {(k, hashlib.sha256(media.padded((t or "").encode())).hexdigest()) for k, t, *_ in ODD}


def test_media_retries_member_alone(tmp_path):
    bad = media.MediaReader({"index": f"file://{tmp_path}", "root": f"file://{tmp_path}", "tries": "2"})
    import zipfile

    name = str(tmp_path / "a.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(3):
            z.writestr(f"{k}/2.wav", media.to_wav(media.padded(b"hi")))
    spoiled = bytearray(open(name, "rb").read())
    at = zipfile.ZipFile(name).infolist()[1].header_offset
    spoiled[at + 40] ^= 255
    open(name, "wb").write(bytes(spoiled))
    rows = [r for b in bad.read(media.ByteRange((name, 0, 1 << 20))) for r in b.to_pylist()]
    assert [r["error"] is None for r in rows] == [True, False, True]


def test_chat_long_texts(spark):
    """Texts beyond the JSON reader's own bound come back whole, in every kind of layout."""
    n = 25_000_000
    text = F.concat(F.repeat(F.lit("ab[c\n"), n // 5), F.col("no").cast("string"))
    for roles in (("user", "assistant"), ("user", "assistant", "user")):
        for conv in (1, 2, 3):  # lists of both layouts
            rows = spark.createDataFrame([(conv, k, r) for k, r in enumerate(roles)], "conv_id long, no int, role string").select("conv_id", F.col("no").alias("turn"), "role", text.alias("text"))
            got = chat.format_records(chat.records(rows)).select("layout", F.transform("turns", lambda t: F.struct(t["role"], F.char_length(t["text"]), F.right(t["text"], F.lit(3)))).alias("t")).first()
            assert [tuple(x) for x in got["t"]] == [(r, n + 1, f"c\n{k}") for k, r in enumerate(roles)], got["layout"]
            if len(roles) == 2:
                break


def test_chat_unreadable_records(spark):
    """A record that is no JSON object raises; a null one has no turns."""
    frame = lambda x: spark.createDataFrame([(1, x)], "conv_id long, record string")
    assert chat.format_records(frame(None)).first()["formatted"] == ""
    for bad in ('{"prompt": "a', "no json", ""):
        with pytest.raises(Exception, match="no JSON object"):
            chat.format_records(frame(bad)).collect()


def fp(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(docs, texts):
    prints = {k: fp(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{prints[k]:016x}", root[k]) for k in texts}


def test_simhash_blocks_lose_no_link(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    sizes = []
    for block in (16, 4096):
        found = simhash.components(simhash.links(frame, block)).collect()
        sizes.append(len({r["root"] for r in found}) + 300 - len(found))
    assert sizes == [1, 1]


def test_simhash_keep_one(odd):
    kept = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert kept.count(3) == 1 and 1 in kept and 2 not in kept


def test_simhash_keep_one_of_repeated_ids(spark):
    """Only near-duplicates go: rows that share an id, or have none, are rows of their own."""
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (3, a), (9, e), (8, e), (9, c)]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(frame).collect()), key=str)
    assert got == sorted([(3, a), (None, b), (7, c), (7, d), (8, e)], key=str)


def test_mixing(docs, texts):
    got = mixing.plan_mix(docs).collect()
    size = {k: len(t.encode().split()) for k, t in texts.items()}
    total, target = {}, {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
    order = sorted(target)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, want = float(sum(size.values())), set(order), {}
    while True:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > 3 * target[s][1]}
        if not full:
            break
        for s in full:
            want[s] = 3 * target[s][1]
            left -= want[s]
        free -= full
    want |= {s: weights[s] * level for s in free}
    for s in order:
        assert target[s][0] == pytest.approx(want[s]) and abs(total[s] - want[s]) <= 2


def test_mixing_rows_match_plan(docs):
    mixed = mixing.apply_mix(docs).collect()
    words = sum(len(r["text"].encode().split()) for r in mixed)
    assert words == sum(r["taken"] for r in mixing.plan_mix(docs).collect())
    assert mixed[0].asDict().keys() == set(docs.columns)


def test_mixing_many_rows_without_an_id(spark):
    """They spread over the shards of their source, and get their share."""
    rows = [(None, "a", f"w{k} x y") for k in range(3000)] + [(k, "b", "one two") for k in range(1500)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), shard_docs=100).collect()
    taken = [r["taken"] for r in plan if r["source"] == "a"]
    target = next(r["target"] for r in plan if r["source"] == "a")
    assert len(taken) == 3000 and abs(sum(taken) - target) <= 2 and all(0 <= t <= 9 for t in taken)


def test_mixing_odd(odd):
    assert mixing.plan_mix(odd.drop("size")).count() == len(ODD)
    assert mixing.plan_mix(odd.drop("size").where("false")).count() == 0


def test_chat_query(spark):
    rows = queries.op4_chat_format(spark, SF).collect()
    text = "</s>[INST] ok [/INST]"
    own = next(r for r in rows if r["conv_id"] == -7)
    assert own["n_turns"] == 2 and own["loss_chars"] == len(text) and own["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_chat_layouts(spark):
    lines = ['{"prompt": "p", "completion": "c", "extra": 1}', '{"instruction": "i", "input": "x", "output": "o"}', '{"messages": [{"role": "human", "content": "h\\\\e<[]"}, {"role": "assistant", "content": null}]}', '{"conversations": [{"from": "gpt", "value": "v"}]}', '{"other": 1}', None]
    frame = chat.json_turns(spark.createDataFrame([(x,) for x in lines], "j string"), "j")
    frame = frame.withColumn("back", chat.parse(chat.render(frame["turns"])))
    got = {r["j"]: ([(t["role"], t["text"]) for t in r["turns"]], [(t["role"], t["text"]) for t in r["back"]]) for r in frame.collect()}
    want = [[("user", "p"), ("assistant", "c")], [("user", "i"), ("user", "x"), ("assistant", "o")], [("user", "h\\e<[]"), ("assistant", "")], [("assistant", "v")], [], []]
    assert [got[x] for x in lines] == [(w, w) for w in want]


def test_chat_layouts_of_the_query(spark):
    """Records of all four layouts occur, and each conversation reads back as its rows say."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    found = chat.format_records(chat.records(rows)).collect()
    assert {r["layout"] for r in found} >= {"prompt", "messages", "from_value"}
    plain = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["formatted"]) for r in chat.format_chats(rows).collect()}
    assert {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["formatted"]) for r in found} == plain


def test_chat_odd(spark):
    """Columns named like other layouts change nothing; nulls, ties, control marks and empty tables have defined results."""
    rows = [(1, 0, "human", "hi </s>[x]\\e", "p"), (1, 1, "gpt", None, None), (2, None, None, "\u0000\u2028\n\"", "p"), (2, 1, "user", "a", "p"), (2, 1, "user", "a", "p"), (None, 5, "tool", "t" * 300_000, "p")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, prompt string").selectExpr("*", "prompt response", "prompt system", "prompt input", "array(struct(prompt content, prompt role)) messages", "prompt turns")
    want = {1: [("user", "hi </s>[x]\\e"), ("assistant", "")], 2: [("", "\u0000\u2028\n\""), ("user", "a"), ("user", "a")], None: [("tool", "t" * 300_000)]}
    for got in (chat.format_chats(frame), chat.format_records(chat.records(frame))):
        assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in got.collect()} == want
    assert chat.format_chats(frame.where("false")).count() == 0 == chat.format_records(chat.records(frame.where("false"))).count()


def test_lm(docs, texts):
    rows = lm.score(docs, chunk=5000).collect()
    train = {}
    for k, t in texts.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in [*t.encode().lower().split(), None]:
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    for r in rows:
        words = [*texts[r["doc_id"]].encode().lower().split(), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in train for w in words), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((train.get(w, 0) + 1) / (n + v + 1)) for w in words))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_odd(odd):
    assert lm.score(odd).count() == len(ODD)
    assert lm.score(odd.where("false")).count() == 0


def measured_by_hand(text):
    """Counts and fertility of one text, each in the plainest way."""
    import base64
    from collections import Counter

    import sentencepiece
    import tiktoken

    q = quality_rules
    if "models" not in measured_by_hand.__dict__:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(q.public_tokenizers.path(q.MULTI), "rb"))}
        measured_by_hand.models = sentencepiece.SentencePieceProcessor(model_file=q.public_tokenizers.path(q.PIECES)), tiktoken.Encoding("own", pat_str=q.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces, multi = measured_by_hand.models
    w = text.encode().split()
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    chars = sum(len(x.decode()) for x in w)
    counts = (len(w), chars, sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside))
    ids = pieces.encode(text)
    k = max(1, len(ids) // 128)
    blocks = [Counter(t for i, t in enumerate(ids) if i * k // len(ids) == j) for j in range(k)]
    entropy = sum(-sum(n / b.total() * np.log2(n / b.total()) for n in b.values()) for b in blocks) / k if ids else 0
    bytes_ = [pieces.id_to_piece(t).startswith("<0x") and pieces.id_to_piece(t) != "<0x0A>" for t in ids]
    return (*counts, *((chars / len(ids), chars / len(multi.encode_ordinary(text)), sum(bytes_) / len(ids), entropy) if chars else (0, 0, 0, 0)))


def test_quality_rules_equal_brute_force(docs, texts):
    """Every column of every row, and every verdict from bands computed by hand."""
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *quality_rules.MEASURES)
    values = {}
    for k, t in texts.items():
        values[k] = measured_by_hand(t)
        assert [rows[k][n] for n in names] == pytest.approx(values[k]), k
        assert rows[k]["base_failed"] == (values[k][0] < 50 or 100 * values[k][4] > 50 * values[k][0])
    good = [k for k in texts if not rows[k]["base_failed"]]

    def fitted(keys):
        grid = sorted({tuple(rows[k][m] for m in quality_rules.MEASURES) for k in keys})
        if len(grid) < quality_rules.LEAST_TEXTS:
            return None
        out = {}
        for j, m in enumerate(quality_rules.MEASURES):
            x = sorted(g[j] for g in grid)
            q1, q2, q3 = (x[max(0, int(np.ceil(p * len(x))) - 1)] for p in (0.25, 0.5, 0.75))
            out[m] = q2 - max(8 * (q2 - q1), quality_rules.FLOOR[m]), q2 + max(8 * (q3 - q2), quality_rules.FLOOR[m])
        return out

    by_lang = {x: fitted([k for k in good if lang[k] == x]) for x in set(lang.values())}
    by_script = {x: fitted([k for k in good if rows[k]["script"] == x]) for x in {rows[k]["script"] for k in good}}
    assert by_lang["en"] and not by_lang["es"] and by_script["LATIN"]
    for k in good:
        band = by_lang[lang[k]] or by_script[rows[k]["script"]] or quality_rules.WIDE
        assert rows[k]["kept"] == all(low <= rows[k][m] <= high for m, (low, high) in band.items()), k


def test_quality_rules_odd(odd):
    assert not any(r["kept"] for r in quality_rules.judge(odd).collect())


def test_quality_rules_each_measure_rejects(spark, docs):
    """Labels are never read, yet each fertility measure alone rejects texts of low quality and hardly any of high quality."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = quality_rules.judge(docs, keep=("doc_id", "lang")).where("not base_failed").join(labels, "doc_id").collect()
    assert sum(r["kept"] for r in rows if r["quality"] == 1) >= 0.98 * sum(r["quality"] == 1 for r in rows)
    assert sum(r["kept"] for r in rows if r["quality"] == 0) <= 0.1 * sum(r["quality"] == 0 for r in rows)
    plain = [" ".join("".join(random.Random(k * 400 + j).choices(["re", "ed", "in", "th", "on", "er", "es"], k=3)) for j in range(90)) for k in range(150)]
    spoiled = {"entropy": "same word " * 40 + plain[0][:300], "fallback_share": " ".join(chr(0x13000 + k) + w for k, w in enumerate(plain[1].split())), "chars_per_token": " ".join("-".join(w) for w in plain[2].split())}
    frame = spark.createDataFrame([(k, t, "xx") for k, t in enumerate([*plain, *spoiled.values()])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.judge(frame).where("not base_failed").collect()}
    assert all(got[k]["kept"] for k in range(150))
    for k, m in enumerate(spoiled):
        if 150 + k in got:
            assert not got[150 + k]["kept"], m
    assert {151, 152} <= set(got)


def test_quality_rules_copies_move_no_band(spark, docs):
    """A group of copies that is a third of all rows leaves the verdicts of all others as they were."""
    text = docs.orderBy("doc_id").first()["text"]
    many = docs.unionByName(spark.range(1000, 1100).selectExpr("id doc_id").crossJoin(docs.where(docs["doc_id"] == docs.orderBy("doc_id").first()["doc_id"]).drop("doc_id")).select(docs.columns))
    before, after = ({r["doc_id"]: r["kept"] for r in quality_rules.judge(x).collect()} for x in (docs, many))
    assert all(after[k] == v for k, v in before.items()) and text


def test_main_script():
    lines = {"OK: 中文字文本文字很多很多": "CJK", "ж and this is all in Latin script": "LATIN", "https://a.b/ Привет, это русский текст и ещё больше слов": "CYRILLIC", "The Ελληνικά είναι γλώσσα": "GREEK", "123 ...": "OTHER", "": "OTHER", "ab жж 12": "CYRILLIC", "plain": "LATIN"}
    assert {x: quality_rules.main_script(x) for x in lines} == lines


def test_cuts_keep_tokens():
    """Cut texts give the tokens of whole ones in both vocabularies; runs without white space stay whole."""
    rng = random.Random(6)
    meter = quality_rules.Meter(*map(quality_rules.public_tokenizers.path, (quality_rules.PIECES, quality_rules.MULTI)))
    pools = ("ab é\n", "a. 1\t\r\n  ,'s", "中文\u3000字 \x0b\xa0", "don't \n\n  (x) 12 ", "\u2028 a\x85b ")
    for _ in range(600):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60)))
        for most in (1, 3, 8):
            parts = list(quality_rules.cuts(text, most))
            assert "".join(parts) == text and all(len(x) >= most for x in parts[:-1])
            assert [t for x in parts for t in meter.multi.encode_ordinary(x)] == meter.multi.encode_ordinary(text)
            ids = []
            for k, x in enumerate(parts):
                own = k and x[0] == " "
                found = meter.pieces.encode(x[1:] if own else x)
                ids += found[1:] if k and not own else found
            assert ids == meter.pieces.encode(text)
    assert len(list(quality_rules.cuts("字" * 100_000))) == 1


def test_fertility_of_lines_alone(monkeypatch):
    """Texts cut at line feeds measure as whole ones."""
    meter = quality_rules.Meter(*map(quality_rules.public_tokenizers.path, (quality_rules.PIECES, quality_rules.MULTI)))
    text = "\n".join(f"line{k}\twith.tabs" for k in range(400))
    whole = meter.fertility(text, 5000)
    monkeypatch.setattr(quality_rules.cuts, "__defaults__", (50,))
    assert meter.fertility(text, 5000) == whole


def test_repeated_words_of_many_numbers(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (4, 50, 400):
        ids = rng.integers(0, 6, n)
        want = quality_rules.repeated_words(ids)
        with monkeypatch.context() as m:
            m.setattr(quality_rules, "PACKED", 1)
            assert quality_rules.repeated_words(ids) == want == quality_rules.repeated_words(ids + (1 << 22))


CLASHES = ("_text", "_lang", "_script", "n_words", "kept", "base_failed", "chars_per_token", "held_out", "score", "predicted", "upper_share", "_y", "size", "source_size", "target", "taken", "full_copies", "_key", "_shard", "_source", "_to", "_r", "_s", "fp", "id", "_id", "n", "component_id", "k", "t", "row", "no", "h", "lit`s".replace("`", ""))


def test_stages_with_clashing_columns(spark, docs):
    """Columns of any name come out as they went in, and change no decision."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    stages = (quality_rules.filter_docs, lambda d: classifier.filter_docs(d, labels), simhash.keep_one, mixing.apply_mix)
    for stage in stages:
        got = stage(wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHES)
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in stage(docs).collect())
    for query in (quality_rules.judge, bpe.encode_digests, media.media_columns, lm.score, simhash.near_duplicates, mixing.plan_mix, lambda d: classifier.classify(d, labels)):
        assert query(wide).count() == docs.count()


def test_stages_of_empty_tables(spark, docs):
    labels, none = spark.read.parquet(f"{SF}/labels.parquet"), docs.where("false")
    for got in (quality_rules.filter_docs(none), classifier.filter_docs(none, labels), classifier.filter_docs(none, labels.where("false")), simhash.keep_one(none), mixing.apply_mix(none)):
        assert got.columns == docs.columns and got.count() == 0


def test_classifier(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in classifier.classify(docs, labels).collect()}
    held = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in classifier.classify(odd, labels.where("false")).collect())


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""),
    ("<body><nav>menu</nav><article><h1>T &amp; t</h1><p>a<b> b</b>\n c<br><p>d</article><aside>x</aside><footer>f</footer>", "T & t\na b c\nd"),
    ("<div class='cookie-notice'>c</div><main><p>one<form>f</form><div class=ad>ad</div><p>two<section id=comments><p>reader</section></main>", "one\ntwo"),
    ("<header>h</header><div class=content><p>body &lt;x&gt;</p></div><script>var a='</p>'</script>", "body <x>"),
])
def test_html(page, want):
    tree = html.parse(page or "")
    assert html.Wrapper(html.page_wrapper(tree)).text(tree) == want


def sketch(w):
    """A wrapper's nodes as text: ? optional, + repeated."""
    return w.sig + ("+" if w.repeated else "") + ("(" + " ".join(sketch(k) + ("?" if k.pages < w.pages and w.sig != html.GROUP else "") for k in w.kids) + ")" if w.kids else "")


def test_html_alignment():
    a, b = (html.page_wrapper(html.parse(x)) for x in ("<main><h1>x</h1><p>1<p>2<div>k</div></main>", "<main><h1>x</h1><ul><li>k</ul><p>3</main>"))
    main = html.merge(a, b).kids[0]
    assert sketch(main) == "main+(()(h1 ul(()(li)) p+) div?)"
    h1, ul, p = main.kids[0].kids
    assert (h1.varied, h1.common, p.varied, p.common, ul.pages) == (False, {html.digest("x")}, True, set(), 1)


def test_html_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html.common_subsequence(a, b)
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))


def test_html_long_sequences(spark):
    """Sequences of any length and disorder keep every text, and their wrapper follows the longest page."""
    def page(n, step):
        return "<body><nav>menu</nav><article>" + "".join(f"<h2>h{k}</h2><p>p{k}</p>" + (f"<ul><li>l{k}</ul>" if k % step == 0 else "") for k in range(n)) + "</article><footer>f</footer></body>"

    rng = random.Random(2)
    boxes = lambda n: "<body><article>" + "".join(f"<{t}>{t}{k}</{t}>" for k in range(n) for t in [rng.choice(("div", "section", "p", "td"))]) + "</article></body>"
    pages = [("a", page(3000, 7)), ("b", page(2000, 5)), ("c", page(3, 2)), *[("d", boxes(n)) for n in (700, 900, 300)]]
    whole = None
    for _, x in pages:
        w = html.page_wrapper(html.parse(x))
        whole = w if whole is None else html.merge(whole, w)
    assert len(html.nodes_of(whole)) < 2000
    frame = spark.createDataFrame([(k, f"http://h.example/{u}", x) for k, (u, x) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(frame).collect()}
    import re

    for k, (_, x) in enumerate(pages):
        assert got[k] == "\n".join(re.findall(r">([^<]+)<", x.partition("<article>")[2].partition("</article>")[0] + "<"))


def pages_of(sf=SF):
    import duckdb

    return duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()


def article_of(page):
    """By hand, for the marks that the table's pages have: the blocks between <article> and </article>."""
    import html as entities
    import re

    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
    return "\n".join(x for x in lines if x)


def test_html_equals_brute_force(spark):
    rows = pages_of()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert got == {k: (article_of(h or "<article></article>"), len(article_of(h or "<article></article>"))) for k, _, h in rows}


def nameless(page):
    """The page without any name that tells content and furniture apart: div elements, and classes that mean nothing."""
    import re

    page = re.sub(r"(<p><b>[^<]*)<br>", r"\1</p>", re.sub(r"<head>.*?</head>|<!--.*?-->", "", page, flags=re.S))
    page = re.sub(r"<(article|nav|footer|h1|ul|li|p|div)\b[^>]*>", lambda m: f'<div class="k{len(m[1])}x">', page)
    return re.sub(r"</(article|nav|footer|h1|ul|li|p)>", "</div>", page)


def test_html_wrapper_decides(spark):
    """Pages of div elements alone read as before where their host has some pages to compare; without its wrapper no page has a text."""
    rows = [(k, u, h) for k, u, h in pages_of("/root/testdata/sf0.01") if h]
    frame = spark.createDataFrame([(k, u, nameless(h)) for k, u, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(frame).collect()}
    by_host = {}
    for k, u, h in rows:
        by_host.setdefault(u.split("/")[2], []).append((got[k], article_of(h)))
    assert all(a == b for pages in by_host.values() if len(pages) >= html.FIXED_PAGES for a, b in pages)
    empty = html.Wrapper(html.page_wrapper(html.parse("")))
    assert not any(empty.text(html.parse(h)) for _, _, h in rows)


@pytest.mark.parametrize("page,want", [
    ('<article><p title="a hidden gem">main text</p><p hidden>no</p><p style="display: none">no</p></article>', "main text"),
    ('<article><p>a</p><div class="legal-text">b</div><section class="story search">c</section><div class="search">no</div></article>', "a\nb\nc"),
    ("<article><p>one<br>two <img src=x> three</p></article>", "one\ntwo three"),
    ("<body>" + "<div>" * 500 + "<article><p>deep</p></article>" + "</div>" * 500 + "</body>", "deep"),
    ("<main><p>x</p><article class=comment>c</article></main><div class='comment-body'>d</div>", "x"),
])
def test_html_names(page, want):
    tree = html.parse(page)
    assert html.Wrapper(html.page_wrapper(tree)).text(tree) == want


def test_html_merges_in_rounds(spark, monkeypatch):
    """However many tasks read a host's pages, and however few wrappers meet at once, the texts are the same."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    monkeypatch.setattr(html, "FAN", 2)
    assert {r["page_id"]: r["text"] for r in html.extract(pages.repartition(11)).collect()} == want


def test_html_odd(spark):
    """Nulls, an empty table, repeated rows and further columns of clashing names."""
    rows = [(1, None, None, "x"), (None, "http://h.example/", "<p>t</p>", "y"), (3, None, "<p>a</p>", None), (3, None, "<p>a</p>", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string").selectExpr("*", "host wrapper", "host id", "host salt", "host text")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(frame).collect()), key=str)
    assert got == sorted([(1, "", 0), (None, "t", 1), (3, "a", 1), (3, "a", 1)], key=str)
    assert html.extract(frame.where("false")).count() == 0


def test_html_deep_nests(spark):
    """End tags of deep blocks close those alone, and furniture stays furniture at any depth."""
    deep = lambda n, x: "<div>" * n + x + "</div>" * n
    pages = [f"<body><div id=wrap><article><p>one</p>{deep(n, f'<nav>menu</nav><p>in{n}</p>')}<p>last</p></article></div><footer>f</footer></body>" for n in (60, 20_000)]
    pages += ["<body>" + "<div>" * 3000 + "<p>open</p></span></i></section>"]
    frame = spark.createDataFrame([(k, "http://h.example/", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(frame).collect()}
    assert got == {0: "one\nin60\nlast", 1: "one\nin20000\nlast", 2: "open"}


def test_html_texts_that_start_alike(spark):
    """Texts that agree in a long passage and differ later are no fixed text."""
    pages = [f"<body><div>{'shared words ' * 40}and {k}</div><p>All rights are kept.</p></body>" for k in range(5)]
    frame = spark.createDataFrame([(k, "http://h.example/", x) for k, x in enumerate(pages)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(frame).collect()} == {k: "shared words " * 40 + f"and {k}" for k in range(5)}


def test_html_fixed_texts_inside_regions(spark):
    """The wrapper takes what all pages of a host share out of their articles, but not what some share, nor all of an article."""
    body = lambda k, extra="": f"<body><p>date {k}</p><article><h1>head {k}</h1><p>one {k}<p>two {k}{extra}<div>Share this page</div></article></body>"
    pages = [("a", body(k)) for k in range(3)] + [("a", body(9, "<pre>copied text</pre>"))] * 3
    pages += [("b", f"<body><p>date {k}</p><article><p>the same</p></article></body>") for k in range(3)] + [("c", body(k)) for k in range(2)]
    frame = spark.createDataFrame([(k, f"http://{h}.example/", x) for k, (h, x) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(frame).collect()}
    plain = [f"head {k}\none {k}\ntwo {k}" for k in range(3)]
    want = plain + ["head 9\none 9\ntwo 9\ncopied text"] * 3 + ["the same"] * 3 + [x + "\nShare this page" for x in plain[:2]]
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("page,want", [
    ('<article class="post share-story">text</article>', "text"),
    ('<nav>menu</nav><main><div class="login-guide"><p>how to log in</p></div></main>', "how to log in"),
    ('<main class="subscribe-page"><p>a long text of the page</p><div class="share">Share</div></main>', "a long text of the page"),
    ('<article class="review sponsored"><p>one</p><section id="comments"><p>a long comment by a reader of the page</p></section></article>', "one"),
    ('<main><article class="newsletter-issue"><p>the issue and all that it says</p></article><article class="promo"><p>buy</p></article></main>', "the issue and all that it says"),
])
def test_html_words_remove_no_article(page, want):
    tree = html.parse(page)
    assert html.Wrapper(html.page_wrapper(tree)).text(tree) == want


def test_html_repeated_headings_stay(spark):
    """Headings and a quotation that all articles of a host share are theirs; what all end or begin with is not."""
    page = lambda k, box: f"<body><nav>menu</nav><{box}><h2>Introduction</h2><p>first {k}</p><blockquote>As the saying goes.</blockquote><p>Note.</p><p>second {k}</p><h2>Conclusion</h2><p>third {k}</p><p>Thank you for reading.</p><div>Share this page</div></{box.split()[0]}><footer>f</footer></body>"
    boxes = ("article", "div class=content", "article class='share-story post'")
    frame = spark.createDataFrame([(6 * h + k, f"http://h{h}.example/", page(k, box)) for h, box in enumerate(boxes) for k in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(frame).collect()}
    assert got == {6 * h + k: f"Introduction\nfirst {k}\nAs the saying goes.\nNote.\nsecond {k}\nConclusion\nthird {k}" for h in range(3) for k in range(6)}


def segment_by_hand(run, counts, log_n):
    """All ways to split a run; the first of the cheapest."""
    cost = lambda w: log_n - np.log(counts[w]) if w in counts else log_n + urls.UNSEEN * len(w)
    ways = [[]]
    out = None
    for bits in range(1 << (len(run) - 1)):
        at = [0, *[k + 1 for k in range(len(run) - 1) if bits >> k & 1], len(run)]
        ways = [run[x:y] for x, y in zip(at, at[1:])]
        total = sum(map(cost, ways))
        if out is None or total < out[0] - 1e-9:
            out = total, ways
    return out


def test_segmenter_equals_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        run = "".join(rng.choices("ab", k=rng.randrange(1, 10)))
        counts = {"".join(rng.choices("ab", k=rng.randrange(1, 5))): rng.uniform(1, 100) for _ in range(6)}
        spans = [(i, k, counts[run[i : i + k]]) for i in range(len(run)) for k in range(1, len(run) - i + 1) if run[i : i + k] in counts]
        words = urls.segment(run, spans, 6.0)
        total = sum(6.0 - np.log(counts[w]) if w in counts else 6.0 + urls.UNSEEN * len(w) for w in words)
        assert "".join(words) == run and total == pytest.approx(segment_by_hand(run, counts, 6.0)[0])


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/7x?q"), (2, "https://b.example.com/en/1"), (3, "x.net/de/"), (4, None), (5, "ftp://example.net/de/81")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[2][2:] == ("com/en/", "block")
    assert got[3] == ("", "", None, "allow") == got[4] and got[5][2:] == ("example.net/de/8", "block")
    many = spark.createDataFrame([(k, f"http://{'cheapcasino' if k % 5 == 0 else 'river'}{k % 7}.example.org/fr/{k}") for k in range(200)], "page_id long, url string")
    assert all((r["verdict"] == "block") == (r["page_id"] % 5 == 0) for r in urls.judge(many).collect())


def parts(text):
    import re

    return re.findall(r"[^\W\d_]+", text.lower())


def test_urls_equal_brute_force(spark):
    """Every page's log-odds from counts in dictionaries, and the verdicts that follow."""
    import re
    from collections import Counter

    pages = pages_of()
    got = {r["page_id"]: r for r in urls.judge(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    host = {k: re.split("[/?#]", u.split("://", 1)[1])[0].lower() for k, u, _ in pages}
    path = {k: re.split("[?#]", u.split("://", 1)[1][len(host[k]) :])[0] for k, u, _ in pages}
    counts = Counter(w for k in host for w in parts(" ".join(x for x in host[k].split(".") if "-" in x)) + parts(path[k]))
    total = sum(counts.values())
    lexicon = (*urls.BLOCK_SEEDS, *urls.COMMON_WORDS)
    first = max(50.0, total / 2000)
    log_n = np.log(total + first * len(lexicon) + 1)
    counts.update({w: first for w in lexicon})
    split = lambda run: urls.segment(run, [(i, k, counts[run[i : i + k]]) for i in range(len(run)) for k in range(1, len(run) - i + 1) if run[i : i + k] in counts], log_n)
    words = {k: [w for run in parts(host[k]) for w in split(run)] for k in host}
    bad = {k: bool(set(words[k]) & set(urls.BLOCK_SEEDS)) for k in host}
    of = {c: Counter(w for k in host if bad[k] is c for w in words[k] + parts(path[k])) for c in (True, False)}
    v = len(of[True] | of[False]) + 1
    share = lambda w, c: np.log((of[c][w] + urls.SMOOTHING) / (of[c].total() + urls.SMOOTHING * v))
    prior = np.log((sum(bad.values()) + 1) / (len(bad) - sum(bad.values()) + 1))
    for k in host:
        odds = prior + sum(share(w, True) - share(w, False) for w in words[k] + parts(path[k]))
        r = got[k]
        assert (r["host"], r["path"]) == (host[k], path[k]) and r["log_odds"] == pytest.approx(odds, abs=1e-6)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if odds > 0 else "allow")


def test_urls_held_out(spark):
    """Hosts that did not teach are told apart by words that others taught, with and without a seed word in their name."""
    rng = random.Random(3)
    games, calm = ["roulette", "blackjack", "baccarat", "croupier", "payline"], ["meadow", "harvest", "kettle", "lantern", "orchard"]
    rows = []
    for k in range(120):
        pool = games if k % 3 == 0 else calm
        # Seeds name two thirds of the unwanted hosts; the rest show by their words alone.
        name = "-".join(rng.sample(pool, 2)) + ("-casino" if k % 3 == 0 and k % 9 else "") + f"{k}"
        rows += [(k * 10 + j, f"https://{name}.example.org/x/{rng.choice(pool)}/{rng.choice(pool)}") for j in range(5)]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    from pyspark.sql import functions as F

    got = urls.judge(frame, rules=(), train=lambda host: F.crc32(host.cast("binary")) % 4 != 2).collect()
    held = [r for r in got if zlib.crc32(r["host"].encode()) % 4 == 2]
    seedless = [r for r in held if r["page_id"] // 10 % 9 == 0]
    assert len(held) > 50 and seedless
    assert all((r["verdict"] == "block") == (r["page_id"] // 10 % 3 == 0) for r in held)


def lucky_hosts():
    """Unwanted hosts whose words come with seeds; later ones bear the same words written together, and no seed."""
    rng = random.Random(9)
    odd, plain = ["lucky", "royal", "spin", "fortune", "chips"], ["meadow", "kitchen", "history", "engine", "violin", "harbour"]
    teach = [f"http://casino-{rng.choice(odd)}-{rng.choice(odd)}-{k}.example.net/fr/x" for k in range(60)] + [f"http://{rng.choice(plain)}-{rng.choice(plain)}-{k}.example.net/fr/y" for k in range(240)]
    later = [("block", f"http://{a}{b}{k}.example.net/fr/z") for k, (a, b) in enumerate((x, y) for x in odd for y in odd)] + [("allow", f"http://{a}{b}{k}.example.net/fr/z") for k, (a, b) in enumerate((x, y) for x in plain for y in plain)]
    return teach, later


@pytest.mark.parametrize("labels", ["seeds", "known"])
def test_urls_segmentation_decides(spark, monkeypatch, labels):
    """Hosts without a seed, their words written together, are told apart by their words; without segmentation they are not."""
    teach, later = lucky_hosts()
    rows = teach + [u for _, u in later]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string")
    known = spark.createDataFrame([(u.split("/")[2], k < 60) for k, u in enumerate(teach)], "host string, bad boolean") if labels == "known" else None
    first = {u.split("/")[2] for u in teach}
    judged = lambda: {r["page_id"]: r["verdict"] for r in urls.judge(frame, train=lambda h: h.isin(*first), known=known).collect()}
    want = [v for v, _ in later]
    got = judged()
    right = [got[len(teach) + k] == v for k, v in enumerate(want)]
    assert sum(right) == len(right)
    monkeypatch.setattr(urls, "segmented", lambda runs, *_: runs.select("run", F.array("run").alias("words")))
    got = judged()
    assert len({got[len(teach) + k] for k in range(len(want))}) == 1  # both classes look alike


def test_urls_long_hosts(spark):
    """Runs of any length are split like short ones, in time that grows with their length."""
    long = "casinoriver" * 2000
    frame = spark.createDataFrame([(1, f"http://{long}.example.net/fr/1"), (2, "http://river-house.example.net/fr/2"), (3, "http://river-house2.example.net/fr/2")], "page_id long, url string")
    began = __import__("time").perf_counter()
    got = {r["page_id"]: r["verdict"] for r in urls.judge(frame).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"} and __import__("time").perf_counter() - began < 60
    counts = spark.createDataFrame([("ab", 5.0), ("abc", 5.0), ("c", 9.0)], "w string, n double")
    run = "abcab" * 300
    monkey = {r["run"]: r["words"] for r in urls.segmented(spark.createDataFrame([(run,)], "run string"), counts, 4.0, [1, 2, 3]).collect()}
    spans = [(i, m, n) for i in range(len(run)) for m, w, n in ((2, "ab", 5.0), (3, "abc", 5.0), (1, "c", 9.0)) if run[i : i + m] == w]
    assert monkey[run] == urls.segment(run, spans, 4.0)


def test_urls_of_many_words(spark):
    """A word not seen stays unseen however many others there are; long words count."""
    rng = random.Random(7)
    words = {"".join(rng.choices("bcdfghklmnprtvz", k=5)) for _ in range(100_000)}
    lines, long = sorted(words), "pneumonoultramicroscopicsilicovolcanoconiosis"
    pages = [(k, f"http://plain.example.org/{'/'.join(lines[k * 1000 : k * 1000 + 1000])}", 1) for k in range(len(lines) // 1000)] + [(-1, "http://bestcasinowin.example.org/", 1), (-2, f"http://quickriver{long}.example.org/{long}", 1)]
    frame = spark.createDataFrame(pages, "page_id long, url string, n long").selectExpr("*", "url host", "url path", "url w", "n odds")
    model = urls.Model(frame.select(urls.host_of(frame["url"]).alias("host"), urls.path_of(frame["url"]).alias("path"), "n"))
    found = {}
    for r in model.host_words.collect():
        found.setdefault(r["host"], set()).add(r["w"])
    assert found["bestcasinowin.example.org"] == {"best", "casino", "win", "example", "org"} and found[f"quickriver{long}.example.org"] == {"quick", "river", long, "example", "org"}
    odds = {r["page_id"]: r["log_odds"] for r in urls.judge(frame, rules=()).where("page_id < 0").collect()}
    assert odds[-1] > odds[-2]


def test_urls_odd(spark):
    """Empty tables, repeated rows, nulls and a very long url."""
    frame = spark.createDataFrame([(None, None), (1, "http://" + "a" * 4000 + ".example/" + "b" * 9000), (2, "http://x.example"), (2, "http://x.example"), (3, "http:///p"), (4, "://h?x")], "page_id long, url string")
    got = sorted(((r["page_id"], r["host"][:9], r["path"][:3], r["verdict"]) for r in urls.judge(frame, rules=()).collect()), key=str)
    assert got == sorted([(None, "", "", "allow"), (1, "a" * 9, "/bb", "allow"), (2, "x.example", "", "allow"), (2, "x.example", "", "allow"), (3, "", "/p", "allow"), (4, "h", "", "allow")], key=str)
    assert urls.judge(frame.where("false")).count() == 0


def highest(votes, n, most):
    """Sainte-Lague by the plain rule: one seat after the other to the highest quotient; votes: (votes, order, name)."""
    won = {name: 0 for _, _, name in votes}
    for _ in range(n):
        open_ = [(v / (2 * won[name] + 1), -k, name) for v, k, name in votes if won[name] < most[name]]
        if not open_:
            break
        won[max(open_)[2]] += 1
    return won


def mixed_by_hand(rows, cap=3, seed=17, shard_docs=20):
    """taken of each row of (id, source, words), by plain loops over seats, shards and streams of words."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    total, weight = sum(size.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    full, target = set(), {}
    while True:
        level = (total - sum(cap * size[s] for s in full)) / max(1, sum(weight[s] for s in sources if s not in full))
        new = {s for s in sources if s not in full and weight[s] * level > cap * size[s]}
        if not new:
            break
        full |= new
    target = {s: cap * size[s] if s in full else weight[s] * level for s in sources}
    block = min(4096, max(1, total // (1 << 20)))
    blocks = highest([(target[s], k, s) for k, s in enumerate(sources)], int(total // block), {s: cap * size[s] // block for s in sources})
    md5 = lambda x: int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:8], 16)
    key = lambda i: hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    out = {}
    for s in sources:
        own = [(i, n) for i, t, n in rows if t == s]
        count = (len(own) - 1) // shard_docs + 1
        shards = {}
        for i, n in own:
            shards.setdefault(md5("" if i is None else i) % count, []).append((i, n))
        sizes = {h: sum(n for _, n in x) for h, x in shards.items()}
        quota = highest([(sizes[h], h, h) for h in sorted(shards)], blocks[s], {h: cap * sizes[h] // block + 1 for h in shards})
        for h, members in shards.items():
            words = min(quota[h] * block, cap * sizes[h])
            stream = [i for i, n in sorted(members, key=lambda x: (key(x[0]), x[0] or 0, x[1])) for _ in range(n)]
            start = md5(f"{s or ''}:{h}") % max(1, sizes[h] // block) * block
            for k in range(words):
                i = stream[(start + k) % len(stream)]
                out[i] = out.get(i, 0) + 1
    return out


def test_mixing_equals_brute_force(docs, texts):
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in docs.collect()]
    # Few words a document keep the seats few.
    small = docs.selectExpr("doc_id", "source", "substring(text, 1, 1 + cast(doc_id % 90 as int)) text")
    want = mixed_by_hand([(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in small.collect()])
    got = {r["doc_id"]: r["taken"] for r in mixing.plan_mix(small, shard_docs=20).collect()}
    assert {k: v for k, v in got.items() if v} == want and len(got) == len(rows)


def test_lm_score_equals_brute_force(docs, texts):
    """The whole model in dictionaries: leave-one-out log-ratios by class of context, their bins, and every document's probability."""
    from collections import Counter

    words = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    train = [k for k in words if zlib.crc32(str(k).encode()) % 7 != 2]
    uni = Counter(w for k in train for w in words[k])
    pairs = Counter(p for k in train for p in zip(["<s>", *words[k]], words[k]))
    context = Counter({"<s>": len(train)}) + Counter({w: n for w, n in uni.items() if w is not None})
    n, v = sum(uni.values()), len(uni)
    uniform = 1 / (v + 1)
    klass = lambda c: 0 if c <= 0 else min(lm.CLASSES - 1, 1 + int(np.floor(np.log2(c))))
    place = lambda x: -lm.NONE if x <= 0 else int(np.clip(np.round(np.log(x) / lm.STEP), -lm.NONE + 1, lm.NONE - 1))
    cells = Counter()
    for (a, b), c in pairs.items():
        left = context[a] - 1
        u = (uni[b] - 1) / max(n - 1, 1) / uniform
        cells[klass(left), place(u), place((c - 1) / left / uniform) if left > 0 else -lm.NONE] += c
    weights = lm.fit([(*k, float(c)) for k, c in cells.items()])
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, chunk=5000).collect()}
    for k, line in words.items():
        total = 0.0
        for a, b in zip(["<s>", *line], line):
            w = weights[klass(context[a])]
            total += np.log10(w[0] * uniform + w[1] * uni[b] / n + w[2] * pairs[a, b] / max(context[a], 1))
        assert got[k] == pytest.approx(total, rel=1e-9), k


def test_lm_many_buckets(docs):
    """Requests to very many buckets, each of a few keys, give the same scores."""
    few = {r["doc_id"]: r["score"] for r in lm.score(docs, chunk=20000).collect()}
    old, lm.BUCKET_KEYS = lm.BUCKET_KEYS, 300
    try:
        many = {r["doc_id"]: r["score"] for r in lm.score(docs, chunk=20000).collect()}
    finally:
        lm.BUCKET_KEYS = old
    assert many == pytest.approx(few)


def test_lm_many_chunks_a_bucket(docs, monkeypatch):
    """Requests that are merged in groups, and groups of groups, get the same counts."""
    want = {r["doc_id"]: tuple(r)[1:] for r in lm.score(docs, chunk=3000).collect()}
    monkeypatch.setattr(lm.answers, "__defaults__", (3,))
    got = {r["doc_id"]: tuple(r)[1:] for r in lm.score(docs, chunk=3000).collect()}
    assert got == want and len(want) == 200


def test_media_equals_brute_force(docs, texts):
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for k, t in texts.items():
        raw = t.encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        wav = media.to_wav(pad)
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest()) and r["error"] is None
        mean = sum(pad) / len(pad)
        rms = (sum((x - 128) ** 2 for x in pad) / len(pad)) ** 0.5
        flips = sum((x >= 128) != (y >= 128) for x, y in zip(pad, pad[1:]))
        levels = ",".join(str(sum(x // 16 == j for x in pad) * 1000 // len(pad)) for j in range(16))
        assert r["feature"] == f"mean={mean:.3f};rms={rms:.3f};crossings={flips};levels={levels}"


def test_media_ids_of_text(spark):
    """Ids of any type come back as they were, and ranges over several archives read each member once."""
    rows = [("a/b ü", "x"), (None, "y"), ("", None), ("a/b ü", "x"), ("long" * 20_000, "z")]
    frame = spark.createDataFrame(rows, "key string, body string").repartition(3)
    got = sorted(((r["key"], r["n_bytes"]) for r in media.media_columns(frame, "key", "body", range_bytes=1 << 20).collect()), key=str)
    assert got == sorted([("a/b ü", 1), (None, 1), ("", 0), ("a/b ü", 1), ("long" * 20_000, 1)], key=str)
    assert media.media_columns(frame.where("false"), "key", "body").count() == 0


def test_classifier_equals_brute_force(spark, docs, texts):
    """Statistics by hand, and the compiled rules against the rules themselves."""
    from collections import Counter

    got = {r["doc_id"]: r for r in classifier.with_statistics(docs).collect()}
    for k, t in list(texts.items())[:60]:
        raw = t.encode()
        w = raw.split()
        if not w:
            assert all(got[k][n] == 0 for n in classifier.STATISTICS)
            continue
        chars = sum(map(len, w))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        letters = [c for c in raw if 65 <= c <= 90 or 97 <= c <= 122]
        marks = [c for c in raw if not (65 <= c <= 90 or 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c in b" \t\n\r\x0b\x0c")]
        counts = Counter(w)
        windows = Counter(zip(w, w[1:], w[2:]))
        inside = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        want = {
            "n_words": len(w), "word_chars_mean": chars / len(w), "upper_share": sum(65 <= c <= 90 for c in letters) / max(1, len(letters)), "digit_share": sum(48 <= c <= 57 for c in raw) / chars,
            "mark_share": len(marks) / chars, "symbol_share": sum(c in b"#*$%&<>" for c in raw) / chars, "bar_share": raw.count(b"|") / len(w), "bang_share": raw.count(b"!") / len(w),
            "distinct_share": len(counts) / len(w), "top_share": max(counts.values()) / len(w), "same_next_share": sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w) - 1), "repeat_share": len(inside) / len(w),
            "dup_line_share": sum(x in lines[:j] for j, x in enumerate(lines)) / len(lines), "words_per_line": len(w) / len(lines), "short_line_share": sum(len(x) < 30 for x in lines) / len(lines),
        }
        assert {n: got[k][n] for n in classifier.STATISTICS} == pytest.approx(want), k
    grid = np.array([[r[n] for n in classifier.STATISTICS] for r in got.values()])
    y = (grid[:, 0] > np.median(grid[:, 0])).astype(float)
    b, rules = classifier.fit(grid, y)
    assert rules
    score = b + sum(w * np.array([all((x[k] > t) if above else (x[k] <= t) for k, above, t in rule.parts) for x in grid]) for rule, w in rules)
    frame = classifier.with_statistics(docs).select("doc_id", classifier.score_column(b, rules).alias("s"))
    assert {r["doc_id"]: r["s"] for r in frame.collect()} == pytest.approx({k: 1 / (1 + np.exp(-z)) for k, z in zip(got, score, strict=True)})


def test_classifier_odd_ids(spark, odd):
    """Null and repeated ids with labels: each row has a score, and labels of one id may differ."""
    labels = spark.createDataFrame([(3, 1), (3, 1), (3, 0), (None, 1), (5, 0), (99, 1), (6, None)], "doc_id long, quality int")
    rows = classifier.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)


def test_pipeline_equals_brute_force(spark, docs, texts):
    """Verdicts of the stages, then copies by comparing all fingerprints, then the library's tokens of the mixed rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    left = [r["doc_id"] for r in quality_rules.judge(docs).collect() if r["kept"]]
    now = docs.where(F.col("doc_id").isin(left))
    left = sorted(r["doc_id"] for r in classifier.classify(now, labels).collect() if r["predicted"] == 1)
    prints, root = {k: fp(texts[k]) for k in left}, {k: k for k in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and root[b] < root[a]:
                    root[a], changed = root[b], True
    now = docs.where(F.col("doc_id").isin([k for k in left if root[k] == k]))
    e = bpe.Encoder(bpe.public_tokenizers.path(bpe.VOCABULARY))
    want = []
    for r in mixing.apply_mix(now).collect():
        ids = e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(e.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want) and got


def test_operators_of_empty_tables(spark, docs):
    none = docs.where("false")
    for got in (bpe.encode_digests(none), media.media_columns(none), lm.score(none), simhash.near_duplicates(none), mixing.plan_mix(none), quality_rules.judge(none)):
        assert got.count() == 0


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert set(pipeline.run(spark, SF).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
