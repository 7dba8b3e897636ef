"""Small cases and brute-force versions of the pipeline operators."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from quiverflow.llm import bpe, chat, decontam, html, linededup, lm, minhash, pii, toxicity, vectors

DOC = "doc_id long, text string, extra string"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(["ka", "lo", "mi", "re", "tu"], k=3)) + r.choice(["", "", "", "."]) for _ in range(n))


# PII


def base_spans(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_pii_matches_brute_force(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("aé@@..  --++()1234567890😀_%x9") for _ in range(r.choice([5, 40, 200]))) for _ in range(600)]
    texts += ["", None, "1" * 100_000, "a." * 50_000, "1.2.3.4 " * 5000, "a@b.c_d@e.f", "0001.0.3.255 256.1.1.1", "4111 1111 1111 1111 +49 (170) 1234567."]
    rows = pii.find_pii(docs(spark, *texts)).collect()
    for x in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in x["spans"] if s["kind"] in pii.BASE] == base_spans(x["text"] or "")
    assert rows[0]["extra"] == "x" and pii.find_pii(empty(spark)).count() == 0


def test_pii_and_line_dedup_keep_columns_of_any_name(spark):
    text = "mail to a@b.org now. " + " ".join(f"w{k}" for k in range(30)) + "."
    df = spark.createDataFrame([(k, text, 1, 2, 3, 4) for k in range(2)], "doc_id long, text string, _pii int, _PII_m_email int, GONE int, _key int")
    for x in pii.find_pii(df).collect():
        assert (x["_pii"], x["_PII_m_email"], x["GONE"], x["_key"]) == (1, 2, 3, 4) and [s["kind"] for s in x["spans"]] == ["email"]
    out = linededup.dedup_lines(df).collect()
    assert sorted(x["n_removed"] for x in out)[0] == 0 and len(out) == 2 and {(x["_pii"], x["_PII_m_email"], x["GONE"], x["_key"]) for x in out} == {(1, 2, 3, 4)}


def test_pii_adds_checked_kinds(spark):
    x = pii.find_pii(docs(spark, "iban GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; my ssn is 123-45-6789, part 123-45-6789")).first()
    assert [s["kind"] for s in x["spans"]] == ["iban", "ssn"]


# HTML

PAGE = (
    '<html><head><title>t</title><script>var x="</p>";</script></head><body><div class="cookie-notice">We use cookies.</div><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><main><article><h1>Title &amp; more</h1>'
    "<p><b>One two<br>three.<p>Four\n five<aside class=related><ul><li><a href=a>x</a></ul></aside><div class=ad>Buy</div><form><label>Mail</label><input></form>"
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>Nice post, I like it.</p></div></section></article></main><footer>c</footer></body></html>'
)


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE, "a"), (2, None, "b"), (3, "", "c"), (4, "<", "d"), (4, "<div " * 2000, "e")], "page_id long, html string, text string")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(df).collect()]
    want = "Title & more\n\nOne two three.\n\nFour five"
    assert out[0] == (1, want, len(want)) and out[1] == (2, "", 0) and out[2] == (3, "", 0) and len(out) == 5
    assert html.extract_pages(df.limit(0)).count() == 0


def test_html_of_long_and_odd_pages():
    import time

    body = "".join(f"<p>Paragraph number {k} of a long article, with some words in it.</p>" for k in range(300))
    text = html.main_texts([f"<html><body><article><h1>Long</h1>{body}</article><footer>c</footer></body></html>"], html.page_model())[0]
    assert text.count("Paragraph number") == 300 and text.count("\n\n") == 300
    out = html.main_texts(["<article><p>Solve this please: <math>x</math> and <script>1</script>then we are done here.</p></article>"], html.page_model())[0]
    assert out == "Solve this please: x and then we are done here."
    began = time.time()
    for odd in ("<a " * 80_000, "<table>" + "<div>" * 40_000, "<!-- " * 40_000, "</b>" * 60_000):
        html.dom(odd)
    assert time.time() - began < 30


def brute_decode(nodes, score):
    best = None
    for bits in itertools.product([False, True], repeat=len(nodes) - 1):
        keep = (True, *bits)
        if all(not keep[i] or keep[nodes[i].parent] for i in range(1, len(nodes))):
            best = max(best or (-np.inf,), (sum(score[i] for i in range(1, len(nodes)) if keep[i]), keep))
    return list(best[1])


def test_html_decoding_like_enumeration():
    g = np.random.default_rng(4)
    for _ in range(40):
        nodes = [html.Node("#page", "", -1)] + [html.Node("div", "", int(g.integers(0, k))) for k in range(1, 9)]
        score = g.standard_normal(9)
        assert html.decode(nodes, score).tolist() == brute_decode(nodes, score)


def test_html_model_on_held_out_pages():
    x, y = html.labelled(html.training_pages(60, seed=123))
    assert ((html.raw_score(html.page_model(), x) > 0) == (y > 0)).mean() > 0.98


# Chats


def test_chat_round_trip():
    r = random.Random(1)
    bits = ["\\", "###", "#", "</turn>", "\n", ": ", "a", "\\h", "### x: ", "</turn>\n", "é😀"]
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "odd:\nrole"]), "".join(r.choices(bits, k=r.randint(0, 8)))) for _ in range(r.randint(0, 5))]
        text, mask = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[s:e]) for s, e in mask] == [t for role, t in turns if role == "assistant"]


def test_chat_folds_events(spark):
    rows = [(1, 0, "message", "user", "hi", None), (1, 1, "message", "assistant", "", None), (1, 2, "delta", None, "a", None), (1, 3, "delta", None, "b", 1), (1, 4, "regenerate", None, None, 1), (1, 5, "delta", None, "new", 1), (1, 6, "edit", None, "hello", 0), (2, None, None, None, None, None), (None, 1, "message", "user", "x", None)]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, role string, text string, target int")
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_chats(df).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "new")], 2: [("", "")], None: [("user", "x")]}
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


# BPE


def test_bpe_like_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    own = bpe.WordBpe(open(bpe.tokenizer_path(), encoding="utf-8").read())
    r = random.Random(2)
    bits = ["the", "ing", "a", "Σ", "ς", "İ", "é", "é", "\x85", " ", "\n", "1", "²", "!", "'s", "'LL", "😀", "<|endoftext|>", "ǅ", "中文", "\x00"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(2000)] + ["x" * 20_000, "ab" * 10_000, ""]
    for t in texts:
        ids = ref.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == ref.decode(ids, skip_special_tokens=False)
    out = bpe.encode_docs(docs(spark, "The cat", None, ""), decoded="back").collect()
    assert [len(x["ids"]) for x in out] == [2, 0, 0] and out[0]["back"] == "the</w> cat</w>" and out[0]["extra"] == "x"


def test_bpe_like_the_library_over_all_planes():
    """Also letters, marks and capitals that are in only one of the library's and Python's Unicode tables."""
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    own = bpe.WordBpe(open(bpe.tokenizer_path(), encoding="utf-8").read())
    r = random.Random(4)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [*"a1!é\u0301\u0316\u0334Σ ", "'s", "\u0558", "\u088f", "\u07fd", "\u0898", "\u1abf", "\u1c89", "\ua7dc", "\U00010d50", "\U00016ea0", "\U00011930", "\U00011935", "\U00011938", "\U0002b73a"]
    texts = ["".join(r.choices(letters, k=4)) for _ in range(20_000)] + ["".join(r.choices(odd, k=r.randint(1, 9))) for _ in range(20_000)]
    wrong = [t for t, x in zip(texts, ref.encode_batch(texts, add_special_tokens=False), strict=True) if own.encode(t) != x.ids]
    assert not wrong, (len(wrong), wrong[:5])


# Line dedup


def test_line_dedup(spark):
    passage = prose(1, 80)
    texts = [prose(10, 30) + "\n" + passage, prose(11, 30) + "\n" + passage, "short line.\nother " + prose(12, 10), "short line.\nmore " + prose(13, 10), None, "", passage, "x" * 50_000]
    rows = sorted(linededup.dedup_lines(docs(spark, *texts)).collect(), key=lambda x: x["doc_id"])
    assert [r["text"] for r in rows[2:6]] == texts[2:6] and rows[0]["text"] == texts[0] and rows[7]["text"] == texts[7]
    assert rows[1]["text"].startswith(prose(11, 30)[:60]) and len(rows[1]["text"]) < len(texts[1]) - len(passage) // 2 and rows[1]["n_removed"] > 0
    assert len(rows[6]["text"]) < len(passage) // 3
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_finds_every_repeated_passage_of_whole_units(spark):
    """Against brute force over all runs of units, with passages of 51 words and more put into other documents."""
    r = random.Random(5)
    sentence = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n)) + "."
    passages = [" ".join(sentence(n) for n in sizes) for sizes in ([60], [51], [25, 5, 21], [5, 5, 45], [30, 3, 20, 4], [9] * 9, [1] * 55)]
    texts = [p + "\n" + sentence(7) for p in passages]
    for k, p in enumerate(passages * 3):
        texts.append(sentence(1 + k % 12) + "\n\n"[: k % 3] + " " + p + ("\n" if k % 2 else " ") + sentence(30))
    texts += ["\t" + passages[0].replace(" ", "  ", 3) + "\n \n" + sentence(3), sentence(12) + "\n" + sentence(11) + " " + (s := sentence(10)) + " " + s + " " + s + " " + s + " \n\n"]
    rows = sorted(linededup.dedup_lines(docs(spark, *texts)).collect(), key=lambda x: x["doc_id"])
    units = [re.findall(linededup.UNIT.replace(r"\z", r"\Z"), t) for t in texts]
    place, lost, gone = {}, [set() for _ in texts], [set() for _ in texts]
    for d, u in enumerate(units):
        bare = [x.strip() for x in u]
        for i in range(len(u)):
            for chunk in [tuple(bare[i : i + 2])] * (i + 1 < len(u)) + [(bare[i],)] * (len(bare[i].split()) >= 20):
                d0, i0 = place.setdefault(chunk, (d, i))
                if (d0, i0) != (d, i):
                    lost[d] |= set(range(max(i, i0 + len(chunk)) if d0 == d else i, i + len(chunk)))
        for _, run in itertools.groupby(sorted(lost[d]), key=lambda k, n=itertools.count(): k - next(n)):
            run = set(run)
            if sum(len(bare[k].split()) for k in run) >= 20:
                gone[d] |= run
    for d, u in enumerate(units):
        assert rows[d]["n_removed"] == len(gone[d])
        assert rows[d]["text"] == "".join(x for k, x in enumerate(u) if k not in gone[d])
    assert all(p not in x["text"] for x in rows[len(passages) : 4 * len(passages)] for p in passages)
    twice = spark.createDataFrame([(1, passages[0] + " " + texts[0], "x"), (2, passages[1] + "\n" + texts[8], "x"), (2, sentence(40), "x")], DOC)
    assert sorted(x["n_removed"] for x in linededup.dedup_lines(twice).collect())[0] == 0


def test_line_dedup_of_odd_rows(spark, monkeypatch):
    p = prose(4, 60) + "."
    df = spark.createDataFrame([(1, p, 5, 6, 7), (2, p, 8, 9, 10), (None, p, 1, 1, 1), (3, None, 1, 1, 1), (2, p, 8, 9, 10)], "doc_id long, text string, _gone long, _key long, n_removed long")
    out = linededup.dedup_lines(df)
    rows = sorted(out.collect(), key=lambda x: (x["doc_id"] or 0, x["_gone"]))
    assert out.columns == ["doc_id", "text", "_gone", "_key", "n_removed"]
    assert [(x["doc_id"], x["text"], x["_gone"], x["_key"]) for x in rows] == [(None, p, 1, 1), (1, p, 5, 6), (2, "", 8, 9), (2, "", 8, 9), (3, None, 1, 1)]


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """With a hash that is the same for all units, units of different texts stay."""
    monkeypatch.setattr(linededup, "unit_hash", lambda x: linededup.F.lit(1).cast("long"))
    words = lambda c: " ".join([c] * 30) + "."
    assert [x["n_removed"] for x in linededup.dedup_lines(docs(spark, words("a"), words("b"))).collect()] == [0, 0]


def test_line_dedup_stage_like_a_search_for_50_words(spark):
    """The pipeline's stage: no 50 words in a row of whole sentences are left at two places."""
    import corpus_pipeline

    r = random.Random(9)
    sentence = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(n)) + ". "
    passages = ["".join(sentence(n) for n in r.choices([3, 8, 20, 51], k=3)) + sentence(51) for _ in range(8)]
    texts = [sentence(9) + p + sentence(9) for p in passages * 4]
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    left = [x["text"] for x in stage(spark, docs(spark, *texts), "").collect()]

    def repeated(texts):
        words = [t.split() for t in texts]
        n = Counter(tuple(w[k : k + 50]) for w in words for k in range(len(w) - 49))
        return sum(x - 1 for x in n.values())

    assert len(left) == len(texts) and repeated(texts) > 0 and repeated(left) == 0


# Decontamination


def naive_tiles(item, text, least):
    p, t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for a, b in itertools.product(range(len(item)), range(len(text))):
            n = 0
            while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and p[a + n] and t[b + n]:
                n += 1
            best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return out
        p[a : a + n] = t[b : b + n] = [False] * n
        out.append((a, b, n))


def test_tiling_like_brute_force():
    r = random.Random(4)
    for k in range(150):
        item, text = ([r.randrange(2 + k % 4) for _ in range(n)] for n in (18 + k % 30, 40))
        assert decontam.tile(item, text, 3) == naive_tiles(item, text, 3)
        text = [9] * 3 + item[9:] + [9] + item[:9] + [9]
        assert decontam.tile(item, text, 3) == naive_tiles(item, text, 3)
    assert decontam.tile([], [1, 2, 3], 2) == decontam.tile([1, 2, 3], [], 2) == decontam.tile([1, 2, 3], [1, 2], 3) == []


def test_rolling_windows_are_equal_where_tokens_are():
    r = random.Random(8)
    ids = [r.randrange(3) for _ in range(400)]
    for size in (1, 3, 7):
        values = decontam.rolling(np.array(ids), size).tolist()
        assert len(values) == 400 - size + 1 and len(set(values)) == len({tuple(ids[k : k + size]) for k in range(len(values))})
    assert len(decontam.rolling(np.array([1, 2]), 3)) == len(decontam.rolling(np.array([], int), 3)) == 0


def test_leaks_like_brute_force(spark):
    r = random.Random(6)
    items = [prose(k, 20).lower() for k in range(12)] + ["ka lo", "", None]
    texts = [None, ""]
    for k in range(60):
        words = prose(100 + k, 30).split()
        for _ in range(k % 4):
            source = (items[r.randrange(12)]).split()
            a = r.randrange(15)
            words[r.randrange(len(words)) : 0] = source[a : a + r.randrange(3, 21)]
        texts.append(" ".join(words))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            one, two = re.findall(r"\w+", (item or "").lower()), re.findall(r"\w+", (t or "").lower())
            n = sum(x[2] for x in naive_tiles(one, two, min(decontam.LEAST, len(one)))) if one and two else 0
            if n and n >= decontam.COVERAGE * len(one):
                want.add((d, k, len(one), n))
    got = [(x["doc_id"], x["item_id"], x["n_tokens"], x["n_matched"]) for x in decontam.find_leaks(docs(spark, *texts), bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def test_decontamination(spark):
    item = prose(5, 40).lower()
    words = item.split()
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "two words")], "item_id long, text string")
    swapped = " ".join(words[20:] + ["zzz"] + words[:20])
    df = docs(spark, f"a b {item.upper()} c", swapped, " ".join(words[:8]), None, "", "has two words in it")
    assert sorted((x["doc_id"], x["item_id"]) for x in decontam.find_leaks(df, bench).collect()) == [(0, 7), (1, 7), (5, 10)]
    assert sorted(x["doc_id"] for x in decontam.drop_leaks(df, bench).collect()) == [2, 3, 4]
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.find_leaks(empty(spark), bench).count() == 0


# MinHash


def brute_shingles(texts):
    """Weights of shingles as tuples of words, without the module's code."""
    words = [(t or "").lower().split() for t in texts]
    found, n = Counter(w for d in words for w in set(d)), sum(map(bool, words))
    idf = {w: min(np.log((n + 1) / (k + 1)), np.log((n + 1) / (n / 10_000 + 1))) + 1 for w, k in found.items()}
    return [{s: k * sum(idf[w] for w in s) / len(s) for s, k in Counter(tuple(d[i : i + 5]) for i in range(max(1, len(d) - 4)) if d).items()} for d in words]


def brute_similarity(a, b):
    return sum(min(x, b.get(s, 0)) for s, x in a.items()) / sum(max(a.get(s, 0), b.get(s, 0)) for s in {*a, *b}) if a and b else 0.0


def brute_classes(texts):
    s = brute_shingles(texts)
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if texts[a] is not None and texts[b] is not None and root[a] != root[b] and (s[a] == s[b] == {} or brute_similarity(s[a], s[b]) >= 0.8):
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    return root


def test_near_duplicates_like_brute_force(spark):
    r, texts = random.Random(6), []
    for k in range(12):
        words = prose(100 + k, 120).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    texts += [None, "", "", "one two", "one two", "ONE  two"]
    rows = minhash.near_duplicates(docs(spark, *texts)).collect()
    assert [x["class_id"] for x in sorted(rows)] == brute_classes([t.lower() if t else t for t in texts])
    assert minhash.keep_one(docs(spark, *texts)).columns == ["doc_id", "text", "extra"]


def test_near_duplicates_in_blocks_and_rounds(spark, monkeypatch):
    for name, n in (("PIVOTS", 1), ("BLOCK", 4)):
        monkeypatch.setattr(minhash, name, n)
    r, texts = random.Random(9), []
    for k in range(2):
        words = prose(300 + k, 120).split()
        for _ in range(20):
            copy = list(words)
            for _ in range(r.randint(0, 7)):
                copy[r.randrange(len(copy))] = f"edited{r.randrange(9)}"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    got = [x["class_id"] for x in sorted(minhash.near_duplicates(docs(spark, *texts)).collect())]
    assert got == brute_classes(texts)
    assert len(set(got)) > 4


def test_near_duplicates_of_odd_rows(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0 and minhash.keep_one(empty(spark)).count() == 0
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(3, "a b c", "x"), (3, "a b c", "x"), (None, "a b c", "x"), (1, "A  b c", "x"), (5, long, "x"), (6, long + " end", "x"), (7, None, "x"), (8, None, "x"), (9, "", "x"), (10, " \n", "x")]
    df = spark.createDataFrame([(*x, 1) for x in rows], DOC + ", class_id long")
    got = sorted((x["doc_id"], x["class_id"]) for x in minhash.near_duplicates(df).collect())
    assert got == [(1, 1), (3, 1), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (10, 9)]
    kept = minhash.keep_one(df)
    assert kept.columns == ["doc_id", "text", "extra", "class_id"]
    assert sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 5, 7, 8, 9]


def test_samples_agree_as_often_as_weights_overlap():
    """Of unlike texts, however long, hardly any samples are equal; of like ones as many as they are similar."""
    tables, g = minhash.random_tables(48), np.random.default_rng(3)
    for n in (100, 10_000, 100_000):
        unlike = [(np.sort(g.integers(1, 1 << 63, n, np.uint64)), np.full(n, 2.0)) for _ in range(12)]
        s = minhash.samples_of(unlike, tables)
        assert np.mean([(s[a] == s[b]).mean() for a, b in itertools.combinations(range(12), 2)]) < 0.01
    near, like = [], []
    for _ in range(60):
        k = np.sort(g.integers(1, 1 << 63, 300, np.uint64))
        a, b = (k[:280], np.linspace(1, 3, 280)), (k[10:], np.linspace(1, 3, 290))
        near.append(minhash.similarity(a, b))
        x, y = minhash.samples_of([a, b], tables)
        like.append((x == y).mean())
    assert abs(np.mean(near) - np.mean(like)) < 0.03


def test_shingles_look_up_a_slice_of_words_at_once(monkeypatch):
    """The weights are those of each text by itself; rare words cost no call each; long texts are split alone."""
    import pyarrow as pa

    texts = ["", "a", "a b", "a b c d", "a b c d e", "a b c d e f", "a a a a a a a", prose(1, 300), prose(2, 300), " ".join(f"w{k}" for k in range(900)), "c d e f a"]
    held = np.sort([minhash.word_hash(w) for w in ("a", "c", "w7")])
    idf, calls = minhash.Idf(100_000, held, np.array([50_000, 700, 20])), []
    got = minhash.Shingler(lambda words: calls.append(len(words)) or idf(words))([minhash.words_of(t) for t in texts])
    assert len(calls) <= 5 and max(calls) < 1500
    for t, (key, weight) in zip(texts, got, strict=True):
        w = t.split()
        want = Counter()
        for k in range(len(w) - min(5, len(w)) + 1 if w else 0):
            one = tuple(w[k : k + 5])
            want[one] += sum(idf(np.array([minhash.word_hash(x)]))[0] for x in one) / len(one)
        assert (np.diff(key.astype(object)) > 0).all() and np.allclose(sorted(weight), sorted(want.values()))
    for n in range(len(texts)):  # whatever else is in the slice
        (alone,) = minhash.Shingler(idf)([texts[n].split()])
        assert all(np.array_equal(x, y) for x, y in zip(alone, got[n], strict=True))
    monkeypatch.setattr(minhash, "SPLIT", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([None, "x" * 60, "y" * 40, "z" * 500, "", "v" * 99])], ["text"])
    assert [[len(t or "") for t in b.column(0).to_pylist()] for b in minhash.pieces([batch], "text")] == [[0, 60, 40], [500], [0, 99]]


def test_near_duplicates_recall(spark):
    """Queries: every id divisible by 100, against all rows; recall of the pairs found by brute force."""
    r, texts = random.Random(12), []
    for k in range(100):
        words = prose(1000 + k, 150).split()
        for _ in range(5):
            copy = list(words)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = "".join(r.choices("xyz", k=6))
            texts.append(" ".join(copy))
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[k] for k in order]
    s = brute_shingles(texts)
    df = spark.createDataFrame([(10 * k, t, "x") for k, t in enumerate(texts)], DOC)
    want = {(10 * q, 10 * k) for q in range(0, len(texts), 10) for k in range(len(texts)) if q != k and brute_similarity(s[q], s[k]) >= 0.8}
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(df).collect()}
    recall = sum(got[q] == got[k] for q, k in want) / len(want)
    print("recall", recall, "of", len(want))
    assert len(want) > 30 and recall >= 0.9


# Toxicity


def test_toxicity_held_out(spark):
    r = random.Random(8)
    texts = [prose(k, 60) + (f" {r.choice(['idiot', 'scumbag'])} " + prose(k + 1000, 20) if k % 5 == 0 else "") for k in range(300)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(200)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(docs(spark, *texts, None, ""), docs(spark, *texts), labels).collect()
    assert sum(x["toxic"] == (x["doc_id"] % 5 == 0) for x in out[200:300]) >= 98 and not any(x["toxic"] for x in out[300:])
    assert toxicity.classify(empty(spark), docs(spark, *texts), labels).count() == 0
    assert toxicity.classify(docs(spark, "a"), docs(spark, "a"), labels.limit(0)).filter("not toxic").count() == 1


# Vectors


def test_vectors_like_brute_force(spark):
    g = np.random.default_rng(9)
    base = g.standard_normal((20, 16))
    x = np.concatenate([base, base + 0.05 * g.standard_normal((20, 16)), base[:5], g.standard_normal((60, 16))])
    rows = [(k, [float(c) for c in v], k % 20 // 10) for k, v in enumerate(x)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, [None] + [1.0] * 15, 0), (204, rows[0][1], None), (205, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.link_vectors(df, tile=16).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 20 // 10 == np.arange(len(x)) % 20 // 10)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([root[link[k]].min() for k in range(len(x))])
    assert got == {k: (int(link[k].sum()) - 1, int(root[k])) for k in range(len(x))} | {k: (0, k) for k in range(200, 206)}
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_vectors_repeats_ids_and_columns(spark):
    g = np.random.default_rng(4)
    one = g.standard_normal(8)
    close = [one + 0.01 * g.standard_normal(8) for _ in range(3)]
    rows = [(None, close[0], "a")] + [(k, one, "a") for k in (5, 3, 3)] + [(9, close[1], "a"), (8, close[2], "a"), (7, one, "b"), (6, 1e300 * one, "b")]
    df = spark.createDataFrame([(k, [float(c) for c in v], t, "x", 1) for k, v, t in rows], "vec_id long, embedding array<double>, label string, u string, n_links int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.link_vectors(df, tile=2).collect()), key=str)
    a = [(3, 5, 3, True)] * 2 + [(5, 5, 3, False), (8, 5, 3, False), (9, 5, 3, False), (None, 5, None, None)]
    assert got == sorted(a + [(6, 1, 6, True), (7, 1, 6, False)], key=str)


def test_open_pairs_are_those_between_the_bounds():
    g = np.random.default_rng(2)
    x = g.standard_normal((40, 24))
    u = vectors.unit(np.concatenate([x, x + 0.2 * g.standard_normal((40, 24))]))
    least, most = vectors.bounds(vectors.quantise(u), vectors.quantise(u))
    assert (least <= u @ u.T).all() and (u @ u.T <= most).all() and ((least < 0.98) & (most >= 0.98)).any()


def test_quantisation_bound_holds():
    g = np.random.default_rng(1)
    u = g.standard_normal((200, 32))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, a, e = vectors.quantise(u)
    near = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(u @ u.T - near) <= e[:, None] * a + a[:, None] * e + e[:, None] * e + 1e-9).all()


# Language models


def lm_losses(texts, good, k):
    """The losses of text k, by target and by background, from the other texts' counts."""
    words = [(t or "").lower().split() for t in texts]
    known, out = {w for d in words for w in d}, []
    for ids in (good, range(len(texts))):
        one = Counter(w for j in ids if j != k for w in words[j])
        two = Counter(p for j in ids if j != k for p in itertools.pairwise(words[j]))
        loss = 0.0
        for j, x in enumerate(words[k]):
            p = (one[x] + 1) / (sum(one.values()) + len(known))
            if j:
                v = words[k][j - 1]
                p = (two[v, x] + lm.PRIOR * p) / (one[v] + lm.PRIOR)
            loss -= np.log(p) / len(words[k])
        out.append(loss)
    return out


@pytest.mark.parametrize("letters", [lm.LETTERS, 300])
def test_lm_like_brute_force(spark, letters):
    texts = [prose(k % 7, 40) for k in range(40)] + ["ka ka ka", None, "", prose(99, 5000)]
    good = [k for k in range(40) if k % 7 < 3]
    rows = {x["doc_id"]: x for x in lm.score(docs(spark, *texts), spark.createDataFrame([(k,) for k in good], "doc_id long"), letters=letters).collect()}
    assert len(rows) == len(texts)
    for k in (0, 5, 38, 40, 43):
        target, background = lm_losses(texts, good, k)
        assert rows[k]["ce_target"] == pytest.approx(target) and rows[k]["ce_background"] == pytest.approx(background)
        assert rows[k]["ce_diff"] == pytest.approx(target - background) and rows[k]["extra"] == "x"
    assert rows[43]["n_tokens"] == 5000 and rows[41]["n_tokens"] == 0 and rows[42]["ce_diff"] is None


def test_lm_edges(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm.score(empty(spark), none).collect() == []
    schema = "doc_id long, text string, n_tokens string, block string, kept string"
    rows = spark.createDataFrame([(None, "a b a", "z", "q", "w"), (3, "a b", "z", None, "w"), (3, "a b", "z", "q", None)], schema)
    got = lm.score(rows, spark.createDataFrame([(None,), (3,)], "doc_id long")).collect()
    assert sorted(str(x["block"]) for x in got) == ["None", "q", "q"] and {x["n_tokens"] for x in got} == {2, 3}
    a, b = (x for x in got if x["doc_id"] == 3)
    assert a["ce_diff"] == b["ce_diff"] == pytest.approx(lm_losses(["a b a", "a b", "a b"], [1, 2], 1)[0] - lm_losses(["a b a", "a b", "a b"], [1, 2], 1)[1])
    alone = lm.score(rows, none).filter("doc_id is null").first()
    assert alone["kept"] == "w" and alone["ce_target"] == pytest.approx(np.log(2))
