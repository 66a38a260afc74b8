"""Text operators held against brute force, round trips and held-out labels, with awkward rows."""

import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import bpe, dom, html_extract, packing, pii, quality, token_histogram, toxicity, words
from lectern.llm.byte_tokens import ByteTokens, default_path

AWKWARD = [
    None, "", "  \n", "Hello<|endoftext|>World <|ENDOFTEXT|> it's I'LL", "ΑΣ ΣΑΣ İstanbul ß é é Å", "日本語 テキスト 🎉🎉 ½ ²³ 1234", "a\x1cb\x85c　d e\x00f", "x" * 3000, "<|startoftext|>",
    "naïve café's 'S 'Re don't   \n\n x _a_ __", "ﬁ ǅ ŉ ẞ Ω K", "a​b c ⅷ ٣٤ 𝟘", "a × b ÷ c ª º", "tab\t\tx  \n ",
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, t, "c") for k, t in enumerate(AWKWARD)] + [(1, "again", "c"), (None, "no id", "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_word_bpe_equals_the_library(spark, table):
    rows, df = table
    t = library("word_bpe_49k.json")
    expected = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(df).collect()), key=repr) == sorted(expected, key=repr)
    assert bpe.digests(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcdehilnorstu éß'Σ1.,!"), max_size=60))
def test_word_bpe_on_random_words(text):
    model, t = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    assert np.frombuffer(model.encode_batch([text])[0][0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_word_bpe_verifies_and_merges():
    model = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    model.learn([f"{a}{b}ington" for a in ("bar", "wel", "ell", "thq") for b in ("x", "le", "zz")])
    assert 0 < model.merged < 12 and len(model.pair_keys) > 0


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "日本語の記事は長い", "абвгдеж"])
def test_long_words_are_proposed_verified_and_merged(alphabet):
    model, t = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    for n in (bpe.LONGEST + 1, 200, 3000, 60_000):
        word = "".join(rng.choice(list(alphabet), n))
        assert np.frombuffer(model.encode_batch([word])[0][0], "<u4").tolist() == t.encode(word, add_special_tokens=False).ids
    before = model.merged
    repeated = "information" * 200
    assert np.frombuffer(model.encode_batch([repeated])[0][0], "<u4").tolist() == t.encode(repeated, add_special_tokens=False).ids and model.merged <= before + 1


def test_byte_tokens_equal_the_library():
    t = library("byte_bpe_50k.json")
    texts = [x or "" for x in AWKWARD]
    got = ByteTokens(default_path()).encode_batch(texts)
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_whole_texts_go_to_the_encoder(monkeypatch):
    seen = []
    encode = tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: seen.append(text) or encode(self, text))
    texts = ["A text of several words,  it's 12.", "another one\n\n"]
    ByteTokens(default_path()).encode_batch(texts)
    assert seen == texts


def test_byte_tokens_split_every_character_as_the_library():
    t = library("byte_bpe_50k.json")
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}, {c}  {c}{c}s" for c in characters[lo : lo + 500]) for lo in range(0, len(characters), 500)]
    got = ByteTokens(default_path()).encode_batch(texts)
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_byte_tokens_of_very_long_white_space():
    t = library("byte_bpe_50k.json")
    for text in (" " * 1_100_000 + "x", "a b" + "\n" * 1_100_000, "a" + " " * 300_000 + " b<|endoftext|>" + " \n" * 200_000 + "c"):
        assert np.frombuffer(ByteTokens(default_path()).encode_batch([text])[0], np.uint16).tolist() == t.encode(text, add_special_tokens=False).ids


def test_byte_tokens_of_a_vocabulary_in_another_order(tmp_path):
    with open(default_path(), encoding="utf-8") as f:
        model = json.load(f)
    vocab = model["model"]["vocab"]
    vocab["Ġthe"], vocab["Ġand"] = vocab["Ġand"], vocab["Ġthe"]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(model), encoding="utf-8")
    tokens, texts = ByteTokens(str(path)), ["the cat and the dog<|endoftext|> x", ""]
    assert tokens.ranks is None
    assert [np.frombuffer(g, np.uint16).tolist() for g in tokens.encode_batch(texts)] == [Tokenizer.from_file(str(path)).encode(x, add_special_tokens=False).ids for x in texts]


def test_packing_places_every_token_once(spark, table, monkeypatch):
    rows, df = table
    monkeypatch.setattr(packing, "RANGE_TOKENS", 150)
    t = library("byte_bpe_50k.json")
    df = df.unionByName(spark.createDataFrame([(100 + k, "the same copy again and again " * 3, "c") for k in range(200)], df.schema))
    pieces = packing.pack(df, length=64).collect()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    filled = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        filled.append(at)
    assert sorted(filled)[1:] == [64] * (len(filled) - 1) and sorted(sequences) == list(range(len(sequences)))
    texts = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] not in (None, 1)}
    for i, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert packing.pack(df.limit(0)).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    path = grid[np.argsort(packing.hilbert(grid, 4))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_token_limits_equal_brute_force(spark, table):
    rows, df = table
    t = library("byte_bpe_50k.json")
    n = np.array([len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows])
    got = {r["n_tokens"]: r for r in token_histogram.token_length_limits(df).collect()}
    assert sorted(got) == sorted(set(n.tolist()))
    for limit, r in got.items():
        assert (r["n_docs"], r["docs_up_to"], r["docs_over"]) == ((n == limit).sum(), (n <= limit).sum(), (n > limit).sum())
        assert (r["tokens_up_to"], r["total_tokens"], r["truncated_tokens"]) == (n[n <= limit].sum(), n.sum(), np.minimum(n, limit).sum())
    assert token_histogram.token_length_limits(df.limit(0)).count() == 0


def base_spans(t):
    """The four base kinds by their patterns, as stated."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.d", "@", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "+", "12", ".", " ", "-", "é", "mail@a-b.co.uk", "0" * 20, "79927398713", "(", "\n"]), max_size=12))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert [(a, e, k) for a, e, k, _ in pii.find(text)[0]] == [(a, e, k) for a, _, e, k in base_spans(text)]


def test_added_spans_need_their_checks():
    kinds = lambda t: [(k, t[a:b]) for a, b, k, _ in pii.find(t)[1]]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == [("iban", "DE89 3704 0044 0532 0130 00")] and kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("his ssn is 078-05-1120.") == [("ssn", "078-05-1120")] and kinds("part 078-05-1120.") == []
    assert kinds("call 555-123-4567 now") == [("phone", "555-123-4567")] and kinds("x 555-123-4567 y") == []
    assert kinds("4111111111111111 5500005555555559") == [("card", "4111111111111111"), ("card", "5500005555555559")]


@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " 2024 12", " EUR 500", "-A", " GB82 WEST 1234 5698 7654 32", " ok"])
def test_what_follows_an_iban_does_not_hide_it(after):
    for iban in ("DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"):
        found = [after.strip()] if after.startswith(" GB") else []
        for before in ("", "AB12 CD34 ", "DE88 3704 "):
            text = f"{before}{iban}{after}"
            assert [text[a:b] for a, b, k, _ in pii.find(text)[1] if k == "iban"] == [iban, *found]


def test_masking(spark):
    df = spark.createDataFrame([(1, "me a@b.co, 1.2.3.4", "en", 99), (2, None, "de", 7), (3, "plain", "fr", 5)], "doc_id long, text string, lang string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask_spans(df).collect()}
    assert got == {1: ("me [EMAIL], [IP]", 16), 2: (None, 7), 3: ("plain", 5)}
    assert pii.span_digests(df.limit(0)).count() == 0
    row = next(r for r in pii.span_digests(df).collect() if r["doc_id"] == 2)
    assert (row["n_email"], row["spans"], row["base_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_pii_is_linear_in_awkward_texts():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.find(text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p><p>no";</script><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A  title &amp; more</h1><p><b>First   paragraph, with &eacute;t&#233; and <a href="#">a link</a> inside it.<br><p>Second paragraph goes on for some words, and then it ends.</p>
<div class="ad">Buy now.</div></article><div class="comments"><h2>Comments</h2><div class="comment"><p>Great post!</p></div></div><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (1, "u", PAGE), (None, "u", "<p>x"), (5, "u", "<" * 5000), (6, "u", "<div>" * 3000 + "deep"), (7, "u", '<a "' * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    first = next(r for r in got if r["page_id"] == 1)
    assert first["text"] == "A title & more\nFirst paragraph, with été and a link inside it.\nSecond paragraph goes on for some words, and then it ends."
    assert all(r["text"] == "" for r in got if r["page_id"] in (2, 3))
    assert html_extract.extract(df.limit(0)).count() == 0


SAMPLES = {
    "en": "This is the first paragraph of an English article, which talks about the weather. Then another sentence follows, and one more. " * 3,
    "ru": "Это первый абзац русской статьи, в котором идёт речь о погоде. Затем следует ещё одно предложение, и ещё одно. " * 3,
    "ja": "これは日本語の記事の最初の段落です。ここでは、いくつかの文が続きます。そして、段落は十分に長いので、本文として認識されるべきです。" * 3,
}


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_articles_of_any_script_and_wrapping(lang):
    one, two = SAMPLES[lang].strip(), SAMPLES[lang][:200].strip()
    around = "<nav><a href=/>x</a> <a href=/y>yy</a></nav>", "<footer>(c) 2020 <a href=/t>t</a></footer>"
    pages = {
        f"<html><body><div>{one}</div><div>{two}</div></body></html>": f"{one}\n{two}",
        f"<html><body><article><div>{one}</div><div>{two}</div></article></body></html>": f"{one}\n{two}",
        f"<body>{around[0]}<div><div><p>{one}</p><p>{two}</p></div></div>{around[1]}": f"{one}\n{two}",
        f"<p>{one}</p>": one,
        one: one,
    }
    assert html_extract.main_texts(list(pages), html_extract.trained()) == list(pages.values())


def test_marks_of_training_pages_mean_nothing_elsewhere():
    plain = PAGE.replace("<p>", "<p class='a'>")
    for mark in ("data-gold", "data-gold='abc'", "data-gold=1", "data-gold=0"):
        assert html_extract.main_texts([plain.replace("<p class='a'>", f"<p class='a' {mark}>")], html_extract.trained()) == html_extract.main_texts([plain], html_extract.trained())


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x", "<b><div>x</div>" * 6000, '<a "' * 8000, "<b><p>x" * 6000, "<ul><li>" + "<b>" * 5000 + "<li>x" * 5000, "<i><div>" + "<b>" * 5000 + "</i>" * 5000, "<" * 200_000, "<!--" * 50_000])
def test_parsing_is_linear_in_awkward_pages(page):
    model = html_extract.trained()
    began = time.process_time()
    html_extract.main_texts([page], model)
    assert time.process_time() - began < 5


def test_decoding_is_consistent():
    blocks = dom.Blocks()
    dom.add_page(blocks, 0, PAGE)
    rng = np.random.default_rng(0)
    for _ in range(50):
        keep = dom.decode(blocks, rng.normal(0, 3, len(blocks.page)))
        for i in range(len(keep)):  # below a kept element that is left, nothing is kept again
            chain, k = [], i
            while k >= 0:
                chain.append(bool(keep[k]))
                k = blocks.parent[k]
            assert "".join("1" if c else "0" for c in chain[::-1]).strip("0").count("0") == 0


def test_trees_generalise_to_unseen_pages():
    x, y = html_extract.training_set(60, seed=999)
    assert ((html_extract.trained().margin(x) > 0) == (y > 0)).mean() > 0.95


def labelled_docs(spark, n=600, seed=8):
    """Ordinary, toxic and junk documents with their labels."""
    rng = np.random.default_rng(seed)
    syllables = ["".join(p) for p in zip("bcdfglmnprst" * 3, "aeiou" * 8, "nrsl" * 9)]
    lexicon = ["".join(rng.choice(syllables, 2)) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        words_ = [str(w) for w in rng.choice(lexicon, rng.integers(30, 120))]
        toxic, junk = k % 5 == 0, k % 7 == 0
        if toxic:
            for _ in range(6):
                words_[rng.integers(len(words_))] = str(rng.choice(["vilescum", "dirtrat", "fooltoad"]))
        rows.append((k, " ".join(w.upper() + "!!" for w in words_) if junk else " ".join(words_) + ".", "score"))
        labels.append((k, int(not junk), int(toxic)))
    schema = "doc_id long, text string, label string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("scores, keep, column, positive", [(quality.quality_scores, quality.keep_quality, 0, 1), (toxicity.toxicity_scores, toxicity.drop_toxic, 1, 0)])
def test_classifiers_on_held_out_rows(spark, scores, keep, column, positive):
    docs, labels, truth = labelled_docs(spark)
    got = scores(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]][column] for r in held) >= 0.95 * len(held)
    kept = {r["doc_id"] for r in keep(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"] == positive}
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - quality, quality) AS quality", "IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    again = {r["doc_id"]: r["score"] for r in scores(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)  # held-out labels are never learnt


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_on_awkward_rows(spark, scores):
    docs, labels, _ = labelled_docs(spark, 200)
    odd = spark.createDataFrame([(900, None, "x"), (901, "", "x"), (None, "no id", "x"), (902, "x" * 50_000, "x"), (902, "x" * 50_000, "x")], docs.schema)
    marks = labels.unionByName(spark.createDataFrame([(None, 1, 1), (900, None, None), (1, 0, 1), (901, 1, 0)], labels.schema))
    got = scores(docs.unionByName(odd), marks).collect()
    assert len(got) == 205 and all(0 <= r["score"] <= 1 and r["held_out"] in (True, False) for r in got)
    assert scores(docs.limit(0), labels).count() == 0
    assert scores(docs, labels.limit(0)).where("score < 0 or score > 1").count() == 0


def test_toxic_wording_of_a_rare_language_is_kept():
    rng = np.random.default_rng(1)
    coded = lambda x: words.mix(x.astype(np.uint64))  # noqa: E731  codes are hashes, as word_codes makes them
    common, rare = coded(np.arange(1, 11)), coded(np.arange(11, 16))
    codes, doc, label = [], [], []
    for k in range(4000):  # 1000 toxic documents, 12 of them of a language with its own wording
        own = coded(rng.integers(1000, 3000, 30))
        extra = (rare if k < 12 else common) if k < 1000 else own[:0]
        codes.append(np.concatenate((own, extra))), doc.append(np.full(30 + len(extra), k)), label.append(float(k < 1000))
    model = toxicity.train(np.concatenate(codes), np.concatenate(doc), np.array(label))
    assert all(int(w).to_bytes(8, "little") in model.toxic for w in [*common, *rare])


def test_window_savings_equal_plain_compression():
    rng = np.random.default_rng(4)
    lexicon = np.array([f"word{k}" for k in range(300)])
    texts = [" ".join(rng.choice(lexicon, n)) for n in (1, 5, 15, 16, 17, 40, 200)] + ["", None]
    codes, doc = toxicity.word_codes(pa.array(texts))
    toxic, fill = np.unique(codes)[:40].tobytes(), np.arange(1, 17, dtype=np.uint64)
    model = toxicity.ToxicityModel(toxic + b"\1" * 64, b"\1" * 64, fill)
    expected = []
    for k in range(len(texts)):
        own = codes[doc == k].tolist()
        own += fill[: 16 - len(own)].tolist() if 0 < len(own) < 16 else []
        for at in range(0, len(own), 16):
            window = np.array(own[min(at, len(own) - 16) :][:16], np.uint64).tobytes()
            sizes = [len(toxicity._compressor(d).compress(window)) for d in (model.ordinary, model.toxic)]
            expected.append((k, sizes[0] - sizes[1]))
    assert list(zip(*(x.tolist() for x in model.savings(pa.array(texts))))) == expected and any(s > 0 for _, s in expected)


def test_a_long_document_does_not_end_the_toxicity_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_BYTES", 400_000)
    docs, labels, truth = labelled_docs(spark)
    first = next(k for k in range(-1, -20, -1) if zlib.crc32(str(k).encode()) % 3 != 1)
    long = " ".join(f"w{k % 5000}" for k in range(100_000))
    docs = docs.unionByName(spark.createDataFrame([(first, long, "score")], docs.schema))
    held = [r for r in toxicity.toxicity_scores(docs, labels.unionByName(spark.createDataFrame([(first, 1, 0)], labels.schema))).collect() if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]][1] for r in held) >= 0.95 * len(held)


def test_the_toxicity_sample_is_cut_by_hash_and_label(monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_BYTES", 2000)
    label, order = np.repeat([0, 1], 100), np.random.default_rng(2).permutation(200)
    kept = toxicity._within_budget(label, np.full(200, 100), order)
    assert [sorted(order[kept[label[kept] == k]]) for k in (0, 1)] == [sorted(order[label == k])[:10] for k in (0, 1)]
    assert len(toxicity._within_budget(label, np.full(200, 5000), order)) == 2
    codes = np.arange(16 * 3000 + 5, dtype=np.uint64)
    part, grown = toxicity.excerpt(codes)
    assert len(part) == 16 * toxicity.DOC_WINDOWS and part.max() > 16 * 2500 and grown > 2.9 and toxicity.excerpt(codes[:100])[1] == 1


def test_fits_have_the_size_the_readme_states():
    assert quality.FEATURES == 384 and (toxicity.FIT_DOCS, toxicity.FIT_BYTES) == (4000, 96_000_000)


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 3, 1, 4, 4]), np.array([4, 4, 4, 4, 4.0]))
    assert (np.diff(y) >= 0).all() and x.tolist() == [0, 1, 2, 3, 4] and y[1] == y[2] == 0.5 and y[3] == y[4]


def test_statistics_of_slices_do_not_depend_on_the_batch():
    texts = ["One two. Two!", "", None, "ÉTÉ été\nété", "a b c a b c a b c"]
    whole = quality.statistics(pa.array(texts))
    alone = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, alone)


def test_arrow_batches_are_bounded_by_rows_and_bytes(spark):
    session = spark.newSession()
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    words.bound_batches(session)
    assert [session.conf.get(n).removesuffix("b") for n in names] == [str(words.BATCH_ROWS), str(words.BATCH_BYTES)]
    for n in names:
        session.conf.set(n, "10")
    words.bound_batches(session)
    assert [session.conf.get(n).removesuffix("b") for n in names] == ["10", "10"]


def test_main_text_whatever_its_wrapper_is_called():
    model, rng = html_extract.trained(), random.Random(4)
    lexicon = "the of river quiet morning people window garden history letter market winter paper station early bright stone music report travel".split()
    names = ["has-comments", "no-sidebar", "with-sidebar", "layout-sidebar-right", "widget-content", "news-box", "col-main box", "page-with-comments", "banner-layout", "has-ads"]
    wrappers = [f"<div class='{n}'>|</div>" for n in names] + ["<form id='aspnetForm' action='/'><div>|</div></form>"]
    for wrapper in wrappers:
        for n in (2, 6):
            lines = ["Title of the article", *[" ".join(rng.choices(lexicon, k=42)).capitalize() + "." for _ in range(n)]]
            start, end = wrapper.split("|")
            page = f"<html><body><nav><a href='/'>Home</a><a href='/a'>About us</a></nav>{start}<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:]) + f"{end}<footer>Copyright 2020 Site</footer></body></html>"
            assert html_extract.main_texts([page], model) == ["\n".join(lines)], (wrapper, n)
