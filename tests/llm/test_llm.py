"""The training-data operators: brute-force models, round trips, held-out accuracy and edge cases."""

import random
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from libranta.llm import cuts, garbles, languages, leaks, looks, matches, scans, spellings, subwords, survivors

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, path string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], DOC)


# ---- P8 ----


@pytest.fixture(scope="module")
def encoder():
    return subwords.encoder(subwords.vocabulary_path())


def test_encoding_equals_the_public_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ñ", "数", "👩", "1", "²", "'s", "\x1c", "\xa0", " \n", "==", "<|endoftext|>", "\r", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["a" * 2500, "=" * 900, "ab" * 700, "é" * 300, " " * 300 + "x"]
    for text in texts:
        assert encoder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)[:80]


def test_any_portions_give_the_same_ids(encoder):
    machine = subwords.Transducer(encoder.v)
    data = ("characterisation" * 60).encode()
    whole = machine.feed(data) + machine.close()
    assert sum((machine.feed(data[i : i + 7]) for i in range(0, len(data), 7)), []) + machine.close() == whole
    assert len(machine.tail) == 0


def test_the_computed_lookahead_suffices_and_memory_is_constant(encoder):
    v, rng = encoder.v, random.Random(12)
    assert v.longest < v.lookahead < 2000
    words = [w for w in v.ranks if w.isalpha() and len(w) > 2]
    for kind in range(6):
        data = b"".join(rng.choice(words) if kind < 4 else rng.choice([b"=", b"==", b"===", b"-"]) for _ in range(900 + 300 * kind))[:9000]
        machine, out, most = subwords.Transducer(v), [], 0
        for k in range(0, len(data), 11):
            out += machine.feed(data[k : k + 11])
            most = max(most, len(machine.tail))
        out += machine.close()
        assert b"".join(v.bytes[i] for i in out) == data and most <= v.lookahead + v.longest + 300
        whole = subwords.Transducer(v)
        whole.__class__ = type("Patient", (subwords.Transducer,), {"room": 1 << 30})  # emits nothing before the end
        assert whole.feed(data) + whole.close() == out


def test_lookahead_of_a_small_merge_list():
    small = object.__new__(subwords.Vocabulary)
    small.ranks = {bytes([c]): i for i, c in enumerate(b"abcd")} | {b"cd": 4, b"bc": 5, b"ab": 6}
    assert small.lookahead == 3  # ab waits for bc, which waits for cd


def test_ids_of_empty_null_and_round_trip(spark, encoder):
    frame = docs(spark, [(1, ""), (2, None), (3, "año 数 👩‍🔬\r\n"), (3, "año")])
    got = sorted((r["doc_id"], list(r["ids"])) for r in subwords.encoded(frame).collect())
    assert got[:2] == [(1, []), (2, [])] and len(got) == 4
    back = [r["text"] for r in subwords.decoded(subwords.encoded(frame)).where("doc_id = 3").collect()]
    assert sorted(back) == ["año", "año 数 👩‍🔬\r\n"]


# ---- P10 ----


def test_one_form():
    assert looks.one_form("ａｃcіόn") == looks.one_form("acciόn") == "acción"
    assert looks.one_form("é​ x y­z") == "é x yz"
    assert looks.one_form("10²") == "10²" and looks.one_form("ñ") != looks.one_form("n")
    assert looks.one_form("👩‍🔬") == "👩‍🔬"
    rng = random.Random(2)
    pool = [chr(c) for c in [*range(32, 0x180), *range(0x370, 0x460), *range(0x2000, 0x2070), *range(0x300, 0x320), *range(0xFF01, 0xFF5F)] if unicodedata.category(chr(c)) != "Cn"]
    for _ in range(400):
        once = looks.one_form("".join(rng.choice(pool) for _ in range(30)))
        assert looks.one_form(once) == once


def test_look_alike_pairs_against_brute_force(spark):
    rng = random.Random(3)
    forms = ["uno dos", "uno dоs", "uno dos", "uno tres", "UNO DOS", ""]
    texts = [(i, rng.choice([*forms, None])) for i in range(60)]
    want = {(a, b) for (a, s), (b, t) in combinations(texts, 2) if s and t and s != t and looks.one_form(s) == looks.one_form(t)}
    for rows in (2000, 3):
        got = {(r["doc_a"], r["doc_b"]) for r in looks.look_alikes(docs(spark, texts), group_rows=rows).collect()}
        assert got == want
    assert looks.look_alikes(docs(spark, [])).count() == 0


# ---- P9 ----


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [(k, "Read the passage now please. " + " ".join(rng.choice(words) for _ in range(40)) + ". Who paid?") for k in range(6)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    passage = [i[1].split(". ")[1].split(" ") for i in items]
    texts = [
        (10, "x " + items[0][1].upper()), (11, "intro " + " ".join(passage[1][:25]) + " end"), (12, " ".join(passage[2][:8])), (13, "Read the passage now please. Who paid?"), (14, None), (15, ""),
        (16, " ".join(w if k % 12 else "other" for k, w in enumerate(passage[3]))), (17, " ".join("ｗ" + w[1:] for w in passage[4])), (17, "again"), (18, "z" * 5000),
    ]
    got = {(r["item_id"], r["doc_id"]) for r in leaks.leaked(docs(spark, texts), frame).collect()}
    assert got == {(0, 10), (1, 11), (3, 16), (4, 17)}
    assert {r["doc_id"] for r in leaks.without_leaks(docs(spark, texts), frame).collect()} == {12, 13, 14, 15, 18}
    assert leaks.leaked(docs(spark, texts), frame.limit(0)).count() == 0


def test_leaks_are_found_when_the_memo_is_cleared(monkeypatch):
    monkeypatch.setattr(leaks, "MOST_KNOWN", 30)
    text = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    others = " ".join(f"x{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400))
    items = leaks.Items([(1, [(text.split(" "), False)])])
    found = [t.split(" ") for t in (text, others, text + " more", others + " " + text)]
    assert sorted(d for _, d, *_ in leaks.leaks_of(items, found, 1 / 3)) == [0, 2, 3]


def test_results_do_not_depend_on_blocks_of_items(spark, monkeypatch):
    rng = random.Random(14)
    words = [f"w{k}" for k in range(300)]
    shared = "Read the passage below and give the right answer to the question that follows it."
    items = [(k, f"{shared} " + " ".join(rng.choice(words) for _ in range(20)) + ".") for k in range(12)]
    frame = spark.createDataFrame(items, "item_id long, text string")
    texts = [(100 + k, (items[k][1] if k < 6 else shared + " " + items[k][1][len(shared) + 1 :][: 20 * (k - 5)])) for k in range(12)]
    seen = []
    for block, shard in ((20_000, 1), (4, 1), (1, 50), (1, 100_000)):
        monkeypatch.setattr(leaks, "BLOCK", block)
        monkeypatch.setattr(leaks, "SHARD", shard)
        seen.append(sorted(tuple(r) for r in leaks.leaked(docs(spark, texts), frame).collect()))
    assert seen[0] and all(s == seen[0] for s in seen)
    assert {r[3] for r in seen[0]} <= set(range(21))  # the instruction's words never count


def test_suffix_array_order_and_longest_matches():
    rng = np.random.default_rng(5)
    for base, most in ((5, 4), (3000, 2), (70_000, 3)):
        flat = rng.integers(0, most, 400)
        places = leaks.suffix_array(flat, base, depth=400)
        assert sorted(places.tolist()) == leaks.runs(flat).tolist()
        opened = [tuple(flat[p:].tolist()) for p in places]
        assert opened == sorted(opened)
    items = leaks.Items([(1, [("a b c d e f g h i j".split(), False)]), (2, [("c d e f g k l".split(), False)])])
    text = [items.vocabulary.get(w, 0) for w in "x a b c d e f x c d e f g h i j x x c d e f g k l".split()]
    found = {(int(t), int(p), int(n)) for t, p, n in zip(*leaks.matches(items, np.array([*text, *[0] * 5])), strict=True)}
    flat = [int(x) for x in items.flat]
    want = set()
    for t in range(len(flat)):  # brute force: every pair of places, extended
        for p in range(len(text)):
            n = 0
            while t + n < len(flat) and p + n < len(text) and flat[t + n] == text[p + n] > 0:
                n += 1
            if n >= leaks.SEED and not (t and p and flat[t - 1] == text[p - 1] > 0):
                want.add((t, p, n))
    assert found == want


def test_passages_tell_places(spark):
    text = " ".join(f"w{k}" for k in range(30))
    frame = spark.createDataFrame([(1, text + ".")], "item_id long, text string")
    row = leaks.passages(docs(spark, [(9, "Some words before " + text)]), frame).collect()[0]
    assert [tuple(p) for p in row["places"]] == [(0, 3, 30)] and row["share"] == 1.0


# ---- P2 ----


def test_cuts(spark):
    whole = "The plan of the town was measured by the clerks in the valley."
    other = "The plan of the town was measured by the judges in the river."
    rows = [(i, "s", f"{whole} {other}", None) for i in range(6)]
    rows += [(10, "s", f"{whole} The plan of the town was meas", None), (11, "s", f"{whole} {other[:-1]}", None), (12, "s", f"{whole} The plan of the town...", None), (13, "s", f"{whole} {other[:-1]}, etc...", None)]
    rows += [(14, "s", "N/A", ""), (15, "s", None, "Review | 2020 | Report"), (16, None, "<p>" + whole + "</p>", whole)]
    rows += [(100 + i, "limited", (f"{'abcdefgh'[i]}word " * 40)[:60], None) for i in range(8)] + [(200, "limited", whole, None)]
    frame = spark.createDataFrame(rows, "seq long, source string, abstract string, snippet string")
    got = {(r["seq"], r["field"]): r["how"] for r in cuts.judged(frame).collect()}
    assert got[10, "abstract"] == "broken" and got[12, "abstract"] == "mark"
    assert got[11, "abstract"] is None and got[16, "abstract"] is None and got[16, "snippet"] is None
    assert (14, "abstract") not in got and (15, "snippet") not in got
    assert all(got[100 + i, "abstract"] == "limit" for i in range(8)) and got[200, "abstract"] is None
    report = {r["source"]: r for r in cuts.cut_report(frame).where("field = 'abstract'").collect()}
    assert report["limited"]["hard_chars"] == 60 and report["limited"]["n_cut"] == 8
    assert cuts.cut_values(frame.limit(0)).count() == 0


def test_a_cut_between_words_has_a_soft_limit(spark):
    rng = random.Random(15)
    whole = [" ".join(rng.choice(["river", "of", "the", "measure", "town", "in", "a", "valley"]) for _ in range(60)).capitalize() + "." for _ in range(60)]
    rows = [(i, "soft", t if i < 30 else t[: t.rindex(" ", 0, 201)], None) for i, t in enumerate(whole)]
    rows += [(100 + i, "none", t if i < 30 else t[: 40 + 3 * i], None) for i, t in enumerate(whole)]
    frame = spark.createDataFrame(rows, "seq long, source string, abstract string, snippet string")
    got = {r["seq"]: r["how"] for r in cuts.judged(frame).collect()}
    assert all(got[k] is None for k in (*range(30), *range(100, 130))) and all(got[k] == "limit" for k in range(30, 60))
    assert {got[k] for k in range(130, 160)} == {"broken"}
    copies = spark.createDataFrame([(i, "s", "The plan of the tow", None) for i in range(40)], "seq long, source string, abstract string, snippet string")
    assert {r["how"] for r in cuts.judged(copies).collect()} == {"broken"}  # copies of one text are no spike


# ---- P3 ----


def pages(spark, rows):
    return spark.createDataFrame([(i, t, a, n, "extra") for i, t, a, n in rows], "page_id long, title string, abstract string, authors array<string>, key string")


def test_garbles_round_trip(spark):
    clean = ["La educación intercultural bilingüe", "Relação entre a evasão e a confiança", "Études sur la pêche à l’œuvre", "Año de João y São Tomé", "El niño creció"]
    rows = [(i, clean[i % 5], clean[(i + 1) % 5] + " 20 € ± 3 °C", [clean[(i + 2) % 5]]) for i in range(60)]
    bad = {}
    for i, (text, pages_) in enumerate([(clean[0], ["cp1252"]), (clean[1], ["cp1252", "cp1252"]), (clean[4], ["mac_roman"]), (clean[0], ["cp437"]), (clean[1], ["cp850"])]):
        shown = text
        for page in pages_:
            shown = shown.encode("utf-8").decode(page)
        bad[1000 + i] = (shown, text)
    rows += [(k, shown, None, None) for k, (shown, _) in bad.items()] + [(2000, "educaci�n", "", []), (2001, None, None, [None, "Zoë"]), (2002, "La educaci?n", None, None)]
    got = {(r["page_id"], r["field"]): r for r in garbles.mended(pages(spark, rows)).collect() if r["garbled"]}
    assert {k for k, _ in got} == {*bad, 2000, 2002}
    assert all(got[k, "title"]["restored"] == text for k, (_, text) in bad.items())
    assert garbles.garbled_values(pages(spark, [])).count() == 0


def test_every_chain_is_tried_and_words_of_letters_are_kept():
    shown = "é".encode("utf-8").decode("cp437").encode("utf-8").decode("mac_roman")
    assert "é" in garbles.readings(shown).values()
    mixed = "é".encode("cp1252").decode("cp437").encode("utf-8").decode("cp1252")  # a pair of pages below a misread UTF-8
    assert "é" in garbles.readings(mixed).values()
    assert garbles.candidates("caf&eacute;") .get("café") is True and garbles.candidates("plain") == {}
    assert garbles.regular("L’État SERVIÇO AbC 12") == "  l’état serviço AbC 00 "


def test_plain_values_are_trained_on_too(spark):
    rows = [(k, f"plain words of a title {k}", [], f"Gestión del agua en la región {k}") for k in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, title string, authors array<string>, abstract string")
    values = garbles.values(frame)
    assert values.where("field = 'title'").count() == 40 and values.where("value is null").count() == 0
    tables, _ = garbles.train(values)
    assert tables[2][garbles.slot("pla")] >= 30
    assert {r["field"] for r in garbles.mended(frame).collect()} == {"abstract"}


def test_margins_lie_between_clean_and_garbled_words(spark):
    pages_ = spark.read.parquet("/root/testdata/sf0.01/scraped_pages.parquet")
    rows = garbles.values(pages_)
    tables, letters, margins = garbles.trained(rows)
    assert [t.size for t in tables] == list(garbles.SLOTS) and set(margins) == set(garbles.KINDS) and all(m >= 2 for m in margins.values())
    model = garbles.Model((tables, letters, margins))
    for text in ("investigación", "être", "SERVIÇO", "20 € à l’élève", "12 °C", "qué? no"):
        assert model.mend(text) == (text, False)
    assert model.mend("UMA REVIS�O SISTEM�TICA") == ("UMA REVIS�O SISTEM�TICA", True)
    for text in ("educación", "relação", "público"):
        for page in ("cp1252", "mac_roman", "cp850"):
            assert model.mend(text.encode("utf-8").decode(page)) == (text, True)


# ---- P7 ----


def test_languages_on_held_out_rows(spark):
    papers = spark.read.parquet("/root/testdata/sf0.01/papers.parquet")
    train, held = papers.where("seq % 5 <> 0"), papers.where("seq % 5 = 0")
    rows = languages.segmented(held, languages.training_counts(train)).where("label is not null and title_lang is not null").collect()
    sure = [r for r in rows if r["segments"]]
    right = sum(max({s["lang"] for s in r["segments"]}, key=lambda x: sum(s["words"] for s in r["segments"] if s["lang"] == x)) == r["label"] for r in sure)
    assert right / len(sure) > 0.9  # labels themselves are wrong in some rows


def test_languages_edges(spark):
    counts = [(w, c, 50) for c, t in (("es", "el agua de la ciudad es un caso que los niños toman"), ("en", "the water of the city is a case that children take"), ("pt", "a água da cidade é um caso que as crianças tomam"), ("fr", "l eau de la ville est un cas que les enfants prennent")) for w in t.split()]
    rows = [(1, None, None, None), (2, "", "", {}), (3, "The water of the city", "El agua de la ciudad es un caso. The water of the city is a case.", {"language": "es"}), (4, "12 34", "Sin resumen", {"language": "xx"})]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "seq long, title string, abstract string, metadata map<string,string>, lang string")
    got = {r["seq"]: r for r in languages.segmented(frame, counts).collect()}
    assert [s["lang"] for s in got[3]["segments"]] == ["es", "en"] and got[3]["title_lang"] == "en"
    assert got[1]["segments"] == [] and got[1]["title_lang"] is None and got[4]["title_lang"] is None
    assert [r["l"] for r in spark.createDataFrame([("es-MX",), ("inglés",), ("mul",), ("",), (None,)], "l string").select(languages.label_language(F.col("l")).alias("l")).collect()] == ["es", "en", None, None, None]


# ---- P5 ----


def test_levenshtein_walk_against_brute_force():
    rng = random.Random(6)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(150)}
    trie = spellings.Trie()
    for w in words:
        trie.add(w, 1)

    def near(a, b):
        if a == b:
            return False
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return b in edits

    for w in list(words)[:60]:
        assert {x for x, _ in trie.near(w)} == {x for x in words if near(w, x)}
        assert all((spellings._edits(w, x) == 1) == near(w, x) for x in words if x != w)


def test_names(spark):
    people = ["Carlos Luis Zamata Quirbe"] * 30 + ["Zamata Quirbe, Carlos Luis"] * 12 + ["C. L. Zamata-Quirbe", "ZAMATA QUIRBE, CARLOS", "Charly Zamata Quirbe", "Carlos Luis Zamaata Quirbe", "Zamata Quirbe CL", "Ana Zamata Quirbe", "Zamata Quirbe, Ana", "Anónimo", None, ""]
    others = [f"Lomba Tirpe, {g}" for g in ("Carlos", "Luis", "Ana", "Charly")] * 3
    frame = spark.createDataFrame([(i, [n], u, "x") for i, (n, u) in enumerate(zip([*people, *others], ["Universidad Nacional de Lorpe", "U. Nacional de Lorpe", "Lorpe, Universidad Nacional de", "National University of Lorpe", "Universidad Nacional de Lorpe (UNLO)", "UNLO", "Universidad Privada de Lorpe", None, "N/A", *[None] * 60], strict=False))], "seq long, authors array<string>, university string, name string")
    pairs = {(r["kind"], r["name_a"], r["name_b"]) for r in spellings.linked(frame).collect()}
    linked = {n for k, a, b in pairs if k == "author" and "Carlos Luis Zamata Quirbe" in (a, b) for n in (a, b)}
    assert linked == {"Carlos Luis Zamata Quirbe", "Zamata Quirbe, Carlos Luis", "C. L. Zamata-Quirbe", "ZAMATA QUIRBE, CARLOS", "Charly Zamata Quirbe", "Carlos Luis Zamaata Quirbe", "Zamata Quirbe CL"}
    assert ("author", "Ana Zamata Quirbe", "Zamata Quirbe, Ana") in pairs
    places = {n for k, a, b in pairs if k == "university" for n in (a, b)}
    assert places == {"Universidad Nacional de Lorpe", "U. Nacional de Lorpe", "Lorpe, Universidad Nacional de", "National University of Lorpe", "Universidad Nacional de Lorpe (UNLO)", "UNLO"}
    assert all(a < b for _, a, b in pairs)
    assert spellings.linked(frame.limit(0)).count() == 0


def test_words_of_one_edit_share_a_shard():
    rng = random.Random(17)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 13)))
        i = rng.randrange(len(word))
        other = rng.choice([word[:i] + word[i + 1 :], word[:i] + "x" + word[i:], word[:i] + "x" + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]])
        if len(other) >= 4 and other != word:
            assert set(spellings.word_shards(word, 0)) & set(spellings.word_shards(other, 1)), (word, other)


def test_shards_give_the_same_links_however_they_are_split(spark):
    rows = [("a", f"w{k}", 1) for k in range(40)] + [("b", f"w{k}", 1) for k in range(7)]
    asking, known = (spark.createDataFrame(x, "shard string, word string, n long") for x in (rows, [("a", "wx", 9), ("b", "wy", 9)]))

    def walk(shard):
        asks = shard["asks"].to_numpy(bool)
        import pandas as pd

        return pd.DataFrame([(w, k) for w in shard["word"][asks] for k in shard["word"][~asks]], columns=["word", "right"])

    want = {(w, "wx" if s == "a" else "wy") for s, w, _ in rows}
    for group in (20_000, 3):
        assert {tuple(r) for r in spellings.in_shards(asking, known, walk, "word string, right string", group).collect()} == want


def test_names_with_a_slip_in_the_first_surname_and_shortened_ones(spark):
    names = ["Sofía Laura Bofatal Datacano"] * 6 + ["Bfatal Datacano, Sofía Laura", "Moxiría Bajalles, Tavo", *["Moxiría Bajalles, Gustavo"] * 4, "S. Bofatal Datacano", "Moxiría Bajalles, G.", "Sofía Laura Bofatal", "Pedro Luis Guaro Linte", "Pedro Iván Guaro Linte", "P. Guaro Linte"]
    frame = spark.createDataFrame([(i, [n], None) for i, n in enumerate(names + [f"Otro Nombre{chr(97 + k)}, {g}" for k, g in enumerate(["Sofía", "Gustavo", "Pedro", "Laura", "Luis", "Iván"] * 3)])], "seq long, authors array<string>, university string")
    pairs = {frozenset((r["name_a"], r["name_b"])) for r in spellings.linked(frame).collect()}
    linked = lambda a, b: frozenset((a, b)) in pairs
    assert linked("Sofía Laura Bofatal Datacano", "Bfatal Datacano, Sofía Laura") and linked("Moxiría Bajalles, Tavo", "Moxiría Bajalles, Gustavo")
    assert linked("S. Bofatal Datacano", "Sofía Laura Bofatal Datacano") and linked("Sofía Laura Bofatal", "Sofía Laura Bofatal Datacano") and linked("Moxiría Bajalles, G.", "Moxiría Bajalles, Gustavo")
    assert not any("P. Guaro Linte" in p for p in pairs)  # fits two persons
    assert not linked("Pedro Luis Guaro Linte", "Pedro Iván Guaro Linte")


def test_no_table_of_names_is_sent_to_all(spark, capsys):
    papers = spark.createDataFrame([(["Perez Rojas, Ana"], "Universidad de Salpe"), (["Ana Perez Rojas"], "Univ. de Salpe"), (["Peres Rojas, Ana"], "UNS")], "authors array<string>, university string")
    spellings.linked(papers).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_of_a_cluster_in_blocks(spark):
    frame = spark.createDataFrame([("author", f"n{k:03}", "c") for k in range(50)] + [("author", "alone", "d")], "kind string, name string, cluster string")
    for rows in (200, 7):
        assert spellings.pairs_of(frame, rows).count() == 50 * 49 // 2


# ---- P6 ----


def test_scans(spark):
    base = "the council measured the water in the northern valley during the winter and reported the results to the people of the town"
    clean = [(i, f"Title of the report number\n\n{base}.\n{base}.", "x") for i in range(1, 40)]
    noisy = "Title of the report number\n\nthe council meas-\nured the water in the northern vallcy during the winter and\n— 12 —\n\x0cRUNNING HEAD OF THE BOOK\nreported the results to the people of the t0wn and\n— 13 —\n\x0cRUNNING HEAD OF THE BOOK\nthe council measured the water."
    rows = [*clean, (100, noisy, "x"), (101, None, "x"), (102, "", "x")]
    pdf = spark.createDataFrame(rows, "file_id long, text string, tab string")
    md = spark.createDataFrame([(1, None)], "md_id long, markdown string")
    got = {r["row_id"]: r for r in scans.repaired(pdf, md).collect()}
    assert set(got) == {*range(1, 40), 100}
    row = got[100]
    assert (row["hyphenation"], row["header"], row["page_number"]) == (1, 2, 2) and row["misread"] >= 2
    assert "measured the water in the northern valley during the winter and reported the results to the people of the town" in row["repaired"]
    assert all(got[i][k] == 0 for i in range(1, 40) for k in ("hyphenation", "misread", "header", "page_number"))
    assert scans.noises(pdf.limit(0), md.limit(0)).count() == 0


# ---- P1 and P4 ----

PAPERS = "seq long, id string, source string, title string, authors array<string>, year int, doi string, abstract string, university string, pdf_url string, fetched_at timestamp, sig long"


def scanned(spark, texts):
    pdf = spark.createDataFrame([(i, t, "x") for i, t in texts], "file_id long, text string, tab string")
    return {r["row_id"]: r for r in scans.repaired(pdf, spark.createDataFrame([], "md_id long, markdown string")).collect()}


def test_misread_words_at_the_edges_of_context(spark):
    rows = [(k, "llegaron mucho antes de comer.\nentre ellos hay dos.\nla casa es grande.") for k in range(110)] + [(150 + k, "la easa es larga.") for k in range(4)]
    rows += [(200, "llegaron mucho\nantcs de comer."), (201, "entrc ellos hay dos."), (202, "zzz antcs qqq."), (203, "zzz easa qqq.")]
    got = scanned(spark, rows)
    assert got[200]["repaired"] == "llegaron mucho antes de comer."  # the word before stands on another line
    assert got[201]["repaired"] == "entre ellos hay dos."  # only the word after tells
    assert (got[202]["repaired"], got[202]["misread"]) == ("zzz antes qqq.", 1)  # no word around is known
    assert got[203]["repaired"] == "zzz easa qqq."  # not rare enough beside the other


def test_repair_depends_on_ratios_of_counts_only(spark):
    base = [f"la regresion lineal del modelo {w} fue estable" for w in ("uno", "dos", "tres") for _ in range(20)]
    noisy = ["la regrcsion lineal del modelo uno fue estable", "la regresin lineal del modelo dos fue estable", "la regrcssion lineal del modelo tres fue estable", "la regres1on lineal del rnodelo uno fue estable"]
    seen = []
    for times in (1, 4):
        texts = [(k, t) for k, t in enumerate((base + noisy) * times)]
        got = scanned(spark, texts)
        seen.append([got[len(base) + k]["repaired"] for k in range(4)])
        assert all(got[k]["misread"] == 0 for k in range(len(base)))
    assert seen[0] == seen[1] == [f"la regresion lineal del modelo {w} fue estable" for w in ("uno", "dos", "tres", "uno")]


def test_candidates_against_brute_force(spark):
    rng = random.Random(16)
    common = sorted({"".join(rng.choice("acdehilmnrtu") for _ in range(rng.randrange(3, 9))) for _ in range(120)})
    rare = set()
    for w in common[:60]:
        i = rng.randrange(len(w))
        rare.add(w[:i] + rng.choice(["", "z", "zz", w[i] + "z"]) + w[i + 1 :])
        wrong, right = rng.choice(scans.CONFUSED)
        rare.add(w.replace(right, wrong, 1))
    rare -= set(common) | {""}
    counted = spark.createDataFrame([(w, 100) for w in common] + [(w, 1) for w in sorted(rare)], "word string, n long")

    def cost(word, right):  # the whole table of costs, without a trie
        table = {(0, 0): 0}
        for i in range(len(word) + 1):
            for j in range(len(right) + 1):
                ways = [table.get((i - 1, j), 99) + scans.EDIT, table.get((i, j - 1), 99) + scans.EDIT, table.get((i - 1, j - 1), 99) + (scans.EDIT if i and j and word[i - 1] != right[j - 1] else 0)]
                ways += [table[i - len(a), j - len(b)] + scans.CONFUSION for a, b in scans.CONFUSED if i >= len(a) and j >= len(b) and word[i - len(a) : i] == a and right[j - len(b) : j] == b]
                table[i, j] = min(ways + ([0] if i == j == 0 else []))
        return table[len(word), len(right)]

    asked = [w for w in rare if (w.isalpha() and len(w) > 3) or (not w.isalpha() and any(c.isalpha() for c in w))]
    want = {(w, x) for w in asked for x in common if (c := cost(w, x)) <= (scans.MOST if len(w) > 3 else scans.EDIT - 1) and (c < scans.EDIT or len(x) > 3)}
    for rows in (20_000, 3):
        assert {(r["word"], r["right"]) for r in scans.candidates(counted, rows).collect()} == want


def test_matches_rules():
    space = matches.Space(({}, {"a": 0.5}, {"ana", "luis", "eva"}, 100))
    one = ("a study of social capital in salma", "", "", "ana torbe lindo =", 2010, "")
    work = lambda title, marker="", authors="", year=2010, doi="", other="": matches.same_work(space, one, (title, other, marker, authors, year, doi))
    assert work(one[0], authors="torbe lindo =a", year=2011) == "same"
    assert work("a study of social capitol in salma") == "same"
    assert work(one[0], "p2", one[3]) == ""
    assert work(one[0], authors="eva quilca rosto =") == ""
    assert work(one[0], authors="anna torbe lindo =") == "same"  # a slip in a given name is no other surname
    assert work("a study of social capital in", authors="ana torbe lindo =") == "short"
    assert work("estudio del capital social en salma", other=one[0], authors="torbe lindo =a") == "same"
    assert matches.title_parts("[Artículo] Sobre el agua: parte II") == (["sobre", "el", "agua"], "p2") and matches.title_parts("Sin título") == ([], "")
    assert matches.both_titles("On the water of the hill = Sobre el agua del cerro: parte II") == ("on the water of the hill", "sobre el agua del cerro", "p2")
    assert matches.doi_part(" 10.90001%2FPRC.2001.5. ") == "10.90001/prc.2001.5"


def test_tables_grow_with_the_codes():
    for bits in (16, 20, 26, 32):
        met = 1 - (1 - (1 - matches.NEAR_DEGREES / 180) ** bits) ** matches.tables_for(bits)
        assert matches.FOUND <= met < matches.FOUND + 0.05
    assert matches.tables_for(32) > matches.tables_for(16)


def test_walks_bring_two_languages_together_and_links_need_them():
    rng = random.Random(19)
    words = [(f"{a}{b}agua", f"{b}{a}water") for a in ("b", "c", "d", "f", "g", "l", "m", "n", "p", "r", "s", "t", "br", "cl", "dr", "fl", "gr", "pl", "pr", "tr", "st", "bl", "cr", "gl") for b in ("a", "e", "i", "o", "u", "ai", "eo", "ui", "au", "oi")]
    people = ["".join(rng.choice("abcdeilmnoprst") for _ in range(8)) for _ in range(60)]

    def row(k, way):
        chosen, author = rng.sample(range(len(words)), 6), people[k % 60]
        es, en = (" ".join(words[i][w] for i in chosen) for w in (0, 1))
        return es, en, author

    rows, records = [], []
    for k in range(900):
        es, en, author = row(k, 0)
        records.append(([*es.split(), *(en.split() if k % 3 == 0 else []), f"@{author}"], k % 3 == 0))
    trained = matches.walk_vectors([r for r, _ in records], [t for _, t in records])
    cosine = lambda a, b: float(trained[a] @ trained[b] / np.linalg.norm(trained[a]) / np.linalg.norm(trained[b]))
    words = [(a, b) for a, b in words if a in trained and b in trained]
    assert np.mean([cosine(a, b) for a, b in words]) > np.mean([cosine(words[i][0], words[(i + 7) % len(words)][1]) for i in range(len(words))]) + 0.15
    import pandas as pd

    # candidates with the same four authors shortened to one: the title has to tell, and only trained vectors see that it is the same in another language
    rows, weights = [row(k, 0) for k in range(200)], np.array([5.0, 10.0, -5.0, -2.5, -3.5])
    frame = pd.DataFrame({"title_a": [es for es, _, _ in rows], "title_b": [en for _, en, _ in rows], "other_a": "", "other_b": "", "year_a": 2010, "year_b": 2010})
    frame = frame.assign(authors_a=[f"ana torbe{k} =|bruno {x}z{k} =|clara {x[:4]}dos =|dario {x[3:]}tres =" for k, (_, _, x) in enumerate(rows)], authors_b=[f"ana torbe{k} =" for k in range(200)])
    taken = {}
    for name, vectors in (("trained", trained), ("dropped", {})):
        x = matches.features(matches.Space((vectors, {}, {"ana", "bruno", "clara", "dario"}, 1000)), frame)
        taken[name] = int((1 / (1 + np.exp(-np.column_stack([x, np.ones(200)]) @ weights)) >= 0.15).sum())
    assert taken["trained"] > taken["dropped"] + 10


def test_words_of_all_records_are_trained(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(5))
    topics, authors = [word() for _ in range(300)], [(word(), word()) for _ in range(120)]
    rows = [(k, " ".join([*rng.sample(topics, 5), authors[k % 120][1]]), [f"{authors[k % 120][0]}, Ana"], 2000 + k % 20, None) for k in range(12_000)]
    _, classes, sent, _ = matches.prepared((spark.createDataFrame(rows, "seq long, title string, authors array<string>, year int, doi string"), "seq", "l"))
    trained, _, _, n, _ = sent.broadcast.value
    assert n == 12_000 and {own for _, own in authors} | set(topics) <= set(trained)
    assert classes.count() == n and classes.select("sig").distinct().count() == n


def test_words_and_names_are_counted_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(matches, "FLUSH", 5)  # counts handed on many times add up
    rows = [(k, ["gestion del agua en torbe", "the use of water in torbe", "agua agua y riego", ""][k % 4], ["", "water use"][k % 2], ["torbe +ana =A|lom =", "ana torbe =", "+ana =A", ""][k % 4]) for k in range(400)]
    counts = matches.counted(spark.createDataFrame(rows, "k int, title string, other string, authors string").repartition(3))
    found = {(r["kind"], r["code"], r["w"]): (r["n"], r["m"]) for r in counts.collect()}
    assert counts.count() == len(found)
    assert found[0, "es", ""] == (200, 0) and found[0, "en", ""] == (100, 0) and found[0, "es", "agua"] == (200, 0) and found[0, "en", "torbe"] == (100, 0)
    assert found[1, "", "water"] == (100, 0) and found[1, "", "use"] == (100, 0)  # not where the first title has them
    assert found[2, "", "ana"] == (200, 100) and found[2, "", "torbe"] == (0, 200) and found[2, "", "lom"] == (0, 100)
    assert found[3, "", "torbe"] == (100, 0) and (3, "", "lom") not in found and (3, "", "ana") not in found
    often, kept = matches.lasting(counts, 150)
    assert often == {"agua": 200, "torbe": 200} and kept == set()


def test_ends_of_texts_are_read_only_where_they_can_be():
    drawn, parts = random.Random(5), [*"ab .\n<>/&;#\"“’'»-", "<b>", "</i>", "&nbsp;", "..."]
    for _ in range(20_000):
        text = "".join(drawn.choice(parts) for _ in range(drawn.randint(1, 9)))
        whole = set()
        clean = cuts.TAGS.sub(" ", text)
        bare = cuts.TAIL.sub("", clean).rstrip()
        marked = cuts._marked(cuts.LAST_TAGS.sub("", text)) or cuts._marked(bare)
        stop = bare[-1:] in (".", "!", "?") and not cuts.LONE_DIGIT.search(bare[-8:])
        assert cuts._read(text, whole)[0] == ("mark" if marked else "stop" if stop else "open")
    before = cuts._tail.cache_info().hits
    assert cuts.keys("Los datos de 2010 fueron analizados en Lima")[:2] == cuts.keys("Los datos de 2011 fueron analizados en Lima")[:2] and cuts._tail.cache_info().hits == before
    cuts.keys("Los datos de 2010 fueron analizados en Lima")
    assert cuts._tail.cache_info().hits == before + 1


def test_the_curve_is_fitted_to_all_labelled_pairs(spark):
    title = "gestion del agua de riego en el valle de torbe durante la sequia"
    rows = [(k, f"{title} {k % 7}", [f"Torbe{k % 5}, Ana"], 2000, f"10.1000/x.{k // 2}") for k in range(320)]
    _, classes, sent, _ = matches.prepared((spark.createDataFrame(rows, "seq long, title string, authors array<string>, year int, doi string"), "seq", "l"))
    pairs = classes.select(F.col("sig").alias("a")).crossJoin(classes.select(F.col("sig").alias("b"))).where("a < b")
    weights, least = matches.calibrated(pairs, classes, sent)
    again, least_ = matches.calibrated(pairs.orderBy(F.desc("a")), classes, sent)
    assert pairs.count() > 20_000 and np.array_equal(weights, again) and least == least_ and np.isfinite(weights).all()


def test_hot_buckets_in_blocks_give_the_same_pairs(spark):
    rows = [(k, 7, 0, 0, 2010, 0, 1 + k % 2) for k in range(60)] + [(100 + k, 8, 0, 0, 2010, 0, 3) for k in range(5)]
    buckets = spark.createDataFrame(rows, "sig long, code long, sketch long, names long, year int, marker long, side int")
    seen = []
    for hot in ([], [(7, 9)]):
        codes = spark.createDataFrame(hot, "code long, blocks int")
        seen.append([{tuple(r) for r in matches.candidates(buckets, two, codes).collect()} for two in (True, False)])
    assert seen[0] == seen[1] and len(seen[0][1]) == 60 * 59 // 2 + 10


def test_one_slip_leaves_a_common_bucket_at_any_size():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(4, 10))) for _ in range(300)]
    for n in (1_000, 30_000, 10_000_000):
        space = matches.Space(({}, {}, set(), n))
        for authors in ("ana torbe lindo =", ""):
            titles, slipped = [], []
            for k in range(60):
                title = rng.choices(words, k=4 + k % 12)
                at = rng.randrange(len(title))
                i = rng.randrange(1, len(title[at]) - 1)
                titles.append(" ".join(title))
                slipped.append(" ".join([*title[:at], title[at][:i] + "z" + title[at][i + 1 :], *title[at + 1 :]]))
            record, code = space.blocks(titles + slipped, [authors] * 120, [""] * 120)[:2]
            held = [set() for _ in range(120)]
            for r, c in zip(record.tolist(), code.tolist(), strict=True):
                held[r].add(c)
            assert all(held[k] & held[60 + k] for k in range(60))


def test_hashing_stays_in_one_thread_and_sums_are_those_of_single_tokens():
    import time

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 10))) for _ in range(3000)]
    titles, authors = [" ".join(rng.choices(words, k=3 + k % 12)) for k in range(6000)], [f"{rng.choice(words)} =a|{rng.choice(words)} ana =" for _ in range(6000)]
    trained = {w: np.arange(matches.DIMENSIONS) - k for k, w in enumerate(words[:200])}
    space = matches.Space((trained, {w: 0.02 for w in words[100:300]}, {"ana"}, 1_000_000))
    space.blocks(titles, authors, [""] * 6000)
    wall, cpu = time.perf_counter(), time.process_time()
    for _ in range(3):
        space.blocks(titles, authors, [""] * 6000)
    assert time.process_time() - cpu <= 1.15 * (time.perf_counter() - wall) + 0.05
    weight = lambda w: 3 if w in words[100:300] else 9
    sums, has = space._sums([titles[0].split(" "), [], titles[5].split(" ")])
    assert has.tolist() == [True, False, True] and not sums[1].any()
    for k, title in ((0, titles[0]), (2, titles[5])):
        assert np.array_equal(sums[k], sum(weight(w) * (matches.base_vector(w) + trained.get(w, 0)) for w in title.split(" ")))
    beside = space._sums([[words[5], words[2000]]], "#")[0][0]
    assert np.array_equal(beside, matches.base_vector(f"#{words[5]}") + trained[words[5]] + matches.base_vector(f"#{words[2000]}"))
    assert np.array_equal(space._sums([[words[7]]], "@")[0][0], matches.base_vector(f"@{words[7]}"))


def test_steps_of_the_training_against_sums_one_by_one():
    rng = np.random.default_rng(3)
    for n in (50, 70_000):  # numbers of nodes that fit into two bytes, and that do not
        rows = np.minimum(rng.zipf(1.4, 4000), n) - 1
        values, matrix = rng.integers(-9, 9, (4000, 3)).astype(np.float32), np.zeros((n, 3), np.float32)
        want = np.zeros((n, 3))
        np.add.at(want, rows, values)
        matches._add(matrix, rows, values)
        times = np.bincount(rows, minlength=n)
        assert np.allclose(matrix, want / np.sqrt(np.maximum(times, 1))[:, None], atol=1e-4)
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        by, sizes, sums = matches._long_first(values, starts, order)
        assert (np.diff(sizes) <= 0).all() and np.array_equal(sizes, times[times > 0][by]) and np.array_equal(sums, want[times > 0][by])


def test_linking_joins_titles_with_a_slip(spark):
    title = "relation between household income and user satisfaction in fishing communities of the old port"
    papers = spark.createDataFrame([(k, title.replace(*swap), ["Ana Torbe Lindo"], 2010, None) for k, swap in enumerate([("household", "houshold"), ("relation", "relatoin"), ("port", "prot"), ("port", "hill and the lake")])], "seq long, title string, authors array<string>, year int, doi string")
    records = spark.createDataFrame([(100, title, [], 2010, None), (101, title, ["Torbe Lindo, Ana"], 2010, None)], "rec_id long, title string, authors array<string>, year int, doi string")
    got = {(r["seq"], r["rec_id"]) for r in matches.linked(papers, records).collect()}
    assert got == {(k, r) for k in range(3) for r in (100, 101)}


def test_translated_titles_of_a_common_place_are_linked(spark):
    surnames = ["Zamata", "Quirbe", "Lomposo", "Vexisco", "Urnada", "Gaquella", "Tipirro", "Bofatal", "Cenduno", "Hivaga", "Nidolma", "Sarpeco"]
    people = [(f"Ana {x}", f"{x}, Ana") for x in surnames]
    here = [("el estudio sobre los jovenes del puerto en simloque", "a study of the youngsters with the harbour in simloque"), ("uma pesquisa das pessoas no cais em simloque", "etude des gens dans le quai de simloque")]
    shape = "authors array<string>, year int, doi string"
    rows = [(k, here[k % 2][0], [one], 2010, None) for k, (one, _) in enumerate(people)]
    rows += [(50 + k, f"el agua de los montes del norte numero w{k}x", ["Eva Quilca"], 2010, None) for k in range(30)]
    papers = spark.createDataFrame(rows, f"seq long, title string, {shape}")
    records = spark.createDataFrame([(100 + k, here[k % 2][1], [two], 2010, None) for k, (_, two) in enumerate(people)], f"rec_id long, title string, {shape}")
    got = {(r["seq"], r["rec_id"]) for r in matches.linked(papers, records).collect()}
    assert got == {(k, 100 + k) for k in range(12)}


def test_places_but_for_a_slip_or_one_more():
    space = matches.Space(({}, {"san": 0.2, "tirande": 0.005}, set(), 1000, {"san", "tirande"}))
    assert matches.places_agree(space, ["san", "tirande"], ["tirande"]) == "same"
    assert matches.places_agree(space, ["tirande"], ["tiramde"]) == matches.places_agree(space, ["tirande"], ["belva", "tirande"]) == "near"
    assert matches.places_agree(space, ["san", "tirande"], ["belva", "san"]) == matches.places_agree(space, ["san"], []) == matches.places_agree(space, [], []) == ""


def test_linking_finds_equal_works_in_the_data(spark):
    papers, records = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("papers", "repo_records"))
    got = {(r["seq"], r["rec_id"]) for r in matches.linked(papers, records).collect()}
    left = [(r["seq"], matches.title_parts(r["title"]), matches.doi_part(r["doi"])) for r in papers.collect()]
    right = [(r["rec_id"], matches.title_parts(r["title"]), matches.doi_part(r["doi"])) for r in records.collect()]
    sure = {(s, r) for s, t, d in left for r, u, e in right if t == u and t[0] and d and d == e}
    assert sure <= got and got
    assert matches.linked(papers.limit(0), records).count() == 0


def test_survivors(spark):
    from datetime import datetime

    t = lambda d: datetime(2024, 1, d)
    a = "We measured the water of the whole valley in the winter."
    same = dict(title="On the water of the northern valley of Salpe", authors=["Ana Torbe Lindo"], year=2010, doi="10.90001/x.2010.1")
    rows = [
        (1, "i1", "s", *same.values(), a, "Universidad Peruana", "https://h.example/bitstream/1/tesis.pdf", t(1), 0),
        (2, "i2", "s", *same.values(), a[:20], "Universidad Nacional de Salpe", "https://h.example/bitstream/1/caratula.pdf", t(5), 0),
        (3, "i3", "s", *same.values(), a, "", None, t(3), 0), (4, "i3", "s", *same.values(), a, None, "about:blank", t(3), 0),
        (5, "i9", "s", "Another thing altogether in the south of Torbe", ["Luis Quilca Rosto"], 2011, None, a, "Universidad Nacional de Salpe", None, t(9), 0),
        (6, None, None, None, None, None, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, PAPERS)
    got = {(r["field"], r["seq"]) for r in survivors.survivors(frame).collect()}
    assert got == {("abstract", 3), ("university", 2), ("pdf_url", 1)}
    assert survivors.survivors(frame.limit(0)).count() == 0
