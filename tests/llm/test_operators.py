"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointset.llm import chat_format, decontamination, fingerprints, jaccard_join, language_id, packing, queries, sharding, substring_dedup, tokens, toxicity
from pointset.llm.common import NO_ID

SF = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat voluptua at vero eos accusam justo duo dolores ea rebum stet clita kasd gubergren".split()
ODD = [None, "", " ", "a", "ab cd", "é" * 150, "x" * 400, "one two three", "One TWO three", "\t\n", "日本 語 " * 60]


def prose(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))


def near(rng, text, share):
    return " ".join(w if rng.random() > share else "changed" + str(rng.randrange(10**6)) for w in text.split(" "))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(5, 400)) for _ in range(25)]
    shared = prose(rng, 60)
    texts = [*base, *ODD, *ODD]
    texts += [near(rng, rng.choice(base), rng.choice([0, 0.005, 0.01, 0.02, 0.05, 0.2])) for _ in range(120)]
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(20)]
    texts += [base[0]] * 15 + [prose(rng, 6000), "z" * 30_000]
    rng.shuffle(texts)
    return [(2 * k + 1, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def keyed(df):
    return {r["doc_key"]: r for r in df.collect()}


# --- chat ---------------------------------------------------------------------------------------------------------------


def test_chat_reads_back(spark):
    rng = random.Random(1)
    pieces = ["<|im_end|>", "<|im_start|>", "assistant", "<\\|", "\\", "\\\\", "<|", "|>", "ok", "\n", "", "é", "<|im_sep|>"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", None]), None if rng.random() < 0.1 else "".join(rng.choices(pieces, k=rng.randrange(6)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    found = chat_format.digest(chat_format.expand(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    assert len(found) == 40
    for r in found:
        own = [(role or "", text or "") for c, _, role, text in turns if c == r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_examples(spark):
    talk = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "<|im_end|>")]
    e = chat_format.expand(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).orderBy("n_turns").collect()
    assert [x["n_turns"] for x in e] == [2, 4]
    assert e[1]["formatted"].startswith(e[0]["formatted"])
    assert [x["formatted"][x["loss_start"] : x["loss_start"] + x["loss_length"]] for x in e] == ["b", "<\\|im_end|>"]


# --- sharding -----------------------------------------------------------------------------------------------------------


def test_lookup_table_fills_evenly_and_moves_little():
    before, after = sharding.lookup_table(16, 2053), sharding.lookup_table(17, 2053)
    assert max(map(before.count, range(16))) - min(map(before.count, range(16))) <= 1
    assert sum(a != b for a, b in zip(before, after, strict=True)) < 2053 * 0.25
    with pytest.raises(ValueError):
        sharding.lookup_table(16, 2052)


def test_place(spark):
    df = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(50)], "doc_id long, slot long")
    found = sharding.place(df, "doc_id").collect()
    assert len(found) == 50
    shards = defaultdict(set)
    for r in found:
        shards[r["row"]["doc_id"]].add((r["slot"], r["shard"]))
    assert all(len(x) == 1 for x in shards.values())


def test_shards_are_written_whole(spark, tmp_path):
    """All rows once, equal keys in one shard, shards in several files; names of columns may clash but for the partition's own."""
    rows = [(k % 50 if k % 3 else 7, k, f"t{k}") for k in range(3000)] + [(None, -1, None)]
    df = spark.createDataFrame(rows, "doc_id long, slot long, text string")
    sharding.write_shards(df, "doc_id", str(tmp_path / "out"), shards=4, slots=101, splits=3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["slot"], r["text"] or "") for r in back if r["doc_id"] is not None) == sorted((False, k, s, t) for k, s, t in rows if k is not None)
    assert len(back) == len(rows)
    shards = defaultdict(set)
    for r in back:
        shards[r["doc_id"]].add(r["shard"])
    assert all(len(x) == 1 for x in shards.values()) and len(set().union(*shards.values())) == 4
    hot = shards[7].pop()
    assert 1 < len(list((tmp_path / "out" / f"shard={hot}").glob("*.parquet"))) <= 3


# --- substring removal --------------------------------------------------------------------------------------------------


def brute_removal(rows, size=100):
    seen, gone = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - size + 1):
            window = raw[k : k + size]
            if window in seen:
                mark[k : k + size] = b"\1" * size
            seen.add(window)
        spans = sum(1 for k in range(len(raw)) if mark[k] and (k == 0 or not mark[k - 1]))
        left = bytes(b for b, m in zip(raw, mark, strict=True) if not m)
        gone[doc] = (len(raw), sum(mark), spans, hashlib.sha256(left).hexdigest())
    return gone


@pytest.mark.parametrize("hot_runs", [20_000, 1])
def test_substring_removal_is_exact(docs, rows, hot_runs):
    found = keyed(substring_dedup.removal_digest(docs, hot_runs=hot_runs))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()} == brute_removal(rows)


def some_runs(rng, n, size):
    """Runs over few letters, the zero byte among them, so that many strings repeat."""
    texts, runs = [], np.zeros(n, substring_dedup.SPAN)
    for k in range(n):
        runs[k] = (k, rng.randrange(5), rng.randrange(1, 12))
        texts.append(bytes(rng.choice(b"\0ab") for _ in range(runs[k]["windows"] + size - 1)))
    return texts, runs


def brute_repeats(texts, runs, size):
    first, every = {}, {}
    for text, (doc, pos, windows) in zip(texts, runs.tolist(), strict=True):
        for w in range(windows):
            every[doc, pos + w] = text[w : w + size]
    for place in sorted(every):
        first.setdefault(every[place], place)
    return {p for p, x in every.items() if first[x] != p}


def places(spans):
    return [(d, p + k) for x in spans for d, p, n in x.tolist() for k in range(n)]


@pytest.mark.parametrize("batch", [1, 7, 40, 10_000])
def test_suffix_family_finds_every_repeat_once(batch):
    rng = random.Random(batch)
    texts, runs = some_runs(rng, 150, 6)
    order = list(range(150))
    rng.shuffle(order)
    family, out = substring_dedup.SuffixFamily(6, batch), []
    for k in range(0, 150, 13):
        own = order[k : k + 13]
        out += family.add(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), runs[own])
    out += list(family.close())
    assert len(family.levels) == 1
    found = places(out)
    assert len(found) == len(set(found)) and set(found) == brute_repeats(texts, runs, 6)
    level = family.levels[0]
    strings = [level.text[a : a + 6].tobytes() for a in level.at.tolist()]
    assert strings == sorted(set(strings))


@pytest.mark.parametrize("stretch", [1, 3, 1 << 15])
def test_merge_scan(stretch):
    rng = random.Random(stretch)
    texts, runs = some_runs(rng, 80, 5)
    halves = [substring_dedup.SuffixArray.of(np.frombuffer(b"".join(texts[k::2]), np.uint8), runs[k::2], 5) for k in (0, 1)]
    level, repeated = substring_dedup.merge_scan(halves[0][0], halves[1][0], 5, stretch)
    assert set(places([halves[0][1], halves[1][1], repeated])) == brute_repeats(texts, runs, 5)
    strings = [level.text[a : a + 5].tobytes() for a in level.at.tolist()]
    assert strings == sorted(set(strings))


@pytest.mark.parametrize("hot", [False, True])
def test_opened_runs_all_leave(hot):
    """However often the runs of a partition are sent on, each leaves once, with its bytes."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcd") for _ in range(300)) for _ in range(40)]
    runs = [[{"pos": 17 * k, "windows": 9, "route": rng.randrange(1 << 62), "hot": hot} for k in range(12)] for _ in texts]
    kinds = pa.list_(pa.struct([("pos", pa.int32()), ("windows", pa.int32()), ("route", pa.int64()), ("hot", pa.bool_())]))
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array([t.decode() for t in texts]), pa.array(runs, kinds)], names=["doc_key", "text", "runs"])
    found = []
    for out in substring_dedup._open_runs(10, 4, 700)(iter([batch, batch.slice(0, 0)])):
        for raw, own, done in zip(*(out.column(c).to_pylist() for c in ("bytes", "runs", "done")), strict=True):
            at = 0
            for doc, pos, windows in substring_dedup.from_columns(own, substring_dedup.SPAN).tolist():
                assert raw[at : at + windows + 9] == texts[doc][pos : pos + windows + 9]
                at += windows + 9
                found += [(doc, pos + w) for w in range(windows)]
            found += places([substring_dedup.from_columns(done, substring_dedup.SPAN)])
    assert sorted(found) == sorted((d, r["pos"] + w) for d in range(40) for r in runs[d] for w in range(9))


def test_dedup_of_rows_without_id_and_of_repeated_ids(spark):
    """Unlike texts are judged on their own; what one repeats of another goes, nothing else does."""
    rng = random.Random(15)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(None, a), (None, b), (None, None), (7, c), (7, a + " tail"), (8, b)]
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert (7, c) in found and (8, b) in found  # the first of each text stays whole
    assert len(found) == len(rows) and sum(len(t) for _, t in found) <= len(a + b + c) + 10


# --- decontamination ----------------------------------------------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randrange(8, 60))) for k in range(60)]
    planted, texts = set(), []
    for k in range(300):
        text = prose(rng, rng.randrange(20, 200)).split(" ")
        if k % 3 == 0:
            item = rng.choice(items)
            own = item[1].split(" ")
            for _ in range(int(0.1 * len(own))):
                own[rng.randrange(len(own))] = "edited"
            at = rng.randrange(len(text))
            text[at:at] = own
            planted.add((k, item[0]))
        texts.append((k, " ".join(text)))
    texts += [(1000, None), (1001, "")]
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, "too short here")], "item_id long, text string")
    d = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r["doc_key"], r["item_key"]) for r in decontamination.find_leaks(d, bench, block_items=25).collect()}
    assert found <= planted and len(found) >= 0.98 * len(planted)
    left = {r["doc_id"] for r in decontamination.without_leaks(d, bench).collect()}
    assert left == {k for k, _ in texts} - {k for k, _ in found}


@pytest.mark.parametrize("size", [5, 8, 12, 16, 24, 60])
def test_recall_at_twenty_percent_of_edits(size):
    """Of items with the most edits that count, substitutions or all kinds, at least nine of ten are found."""
    rng = random.Random(size)
    items = [(k, np.array([rng.getrandbits(63) for _ in range(size)], np.uint64)) for k in range(200)]
    index = decontamination.ItemIndex(items, 6, 6)
    texts, planted = [], set()
    for k, (_, own) in enumerate(items):
        own = own.tolist()
        for at in sorted(rng.sample(range(size), int(0.2 * size)), reverse=True):
            kind = rng.randrange(3) if k % 2 else 0
            new = rng.getrandbits(63)
            own[at : at + 1] = [[new], [], [own[at], new]][kind]
        text = [rng.getrandbits(63) for _ in range(rng.randrange(5, 60))]
        place = rng.randrange(len(text))
        texts.append(text[:place] + own + text[place:])
        planted.add((k, k))
    words, at = np.array([w for t in texts for w in t], np.uint64), np.cumsum([0, *map(len, texts)])
    found = {(t, i) for t, i, *_ in index.verify(words, at, index.candidates(words, at), 0.2)}
    assert found <= planted and len(found) >= 0.9 * len(planted)


def brute_leaks(rows, items, max_edits=0.2):
    """Every document against every item: the least edit distance of the item to any run of the document's words."""
    import re

    def words(t):
        return re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[0-9a-z\u0080-\u2fff]+", (t or "").lower())

    out = {}
    for doc, text in rows:
        part = words(text)
        for item, own_text in items:
            own = words(own_text)
            most = int(max_edits * len(own)) if len(own) >= 5 else 0
            row = [0] * (len(part) + 1)
            for i, w in enumerate(own, 1):
                new = [i]
                for j, p in enumerate(part, 1):
                    new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != p)))
                row = new
            if own and min(row) <= most:
                out[doc, item] = min(row)
    return out


def test_leaks_against_brute_force(spark):
    """No leak that is not one, all exact copies, and nine of ten of the edited ones; short items and scripts without spaces as well."""
    rng = random.Random(31)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 12, 15, 24, 40, 59] * 2)] + [(50, "日本語の問題はここにあります"), (51, "東京 都")]
    rows = []
    for k in range(160):
        text = prose(rng, rng.randrange(0, 60)).split(" ")
        if k % 2:
            own = near(rng, rng.choice(items)[1], rng.choice([0, 0, 0.1, 0.2])).split(" ")
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        rows.append((k, " ".join(text)))
    rows += [(200, "前の文。日本語の問題はここにあります。次の文"), (201, None), (202, items[0][1]), (203, items[3][1])]
    want = brute_leaks(rows, items)
    d, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_key"], r["item_key"]): r["edits"] for r in decontamination.find_leaks(d, bench, block_items=10).collect()}
    assert found.keys() <= want.keys() and all(want[k] <= found[k] for k in found)
    assert {k for k, e in want.items() if e == 0} <= found.keys() and len(found) >= 0.9 * len(want)
    sizes = {i: len(t.split(" ")) for i, t in items[:24]}
    left = {r["doc_id"] for r in decontamination.without_leaks(d, bench).collect()}
    short_only = {doc for doc, _ in want} - {doc for doc, item in want if sizes.get(item, 9) >= 5} - {202, 203}
    assert short_only and short_only <= left and not left & {200, 202, 203}  # a phrase in a document is no leak, a document of nothing else is


def test_nearest_part():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        item, part = [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(4) for _ in range(rng.randrange(12))]
        row = [0] * (len(part) + 1)
        for i, w in enumerate(item, 1):
            new = [i]
            for j, p in enumerate(part, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != p)))
            row = new
        assert decontamination.nearest_part(np.array(item), np.array(part, int))[0] == min(row)


# --- languages and toxicity ---------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    found = keyed(language_id.predict_languages(d))
    assert len(found) == len(truth)
    held = [r for r in found.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in found.items())
    known = [r for r in held if truth[r["doc_key"]] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_key"]] for r in known) >= 0.95 * len(known)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_without_letters(spark):
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate([None, "", "12 34 !", "the end of it"])], "doc_id long, text string, lang string")
    found = keyed(language_id.predict_languages(d))
    assert [found[k]["lang_pred"] for k in range(3)] == ["und"] * 3
    assert {r["doc_id"] for r in language_id.keep_identified(d.where("doc_id < 3")).collect()} == set()


def test_toxicity_on_held_out_documents(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = keyed(toxicity.score_documents(d, labels))
    assert len(found) == d.count()
    pos, neg = [[r["score"] for k, r in found.items() if r["held_out"] and truth.get(k) == y] for y in (1, 0)]
    better = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert better >= 0.85 * len(pos) * len(neg)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found.values())


def test_toxicity_locates_sentences(spark):
    rng = random.Random(6)
    d, labels = [], []
    for k in range(400):
        sentences = [prose(rng, 8) + "." for _ in range(6)]
        if k % 4 == 0:
            sentences[2] = "you vilewort " + prose(rng, 4) + "."
        d.append((k, " ".join(sentences)))
        labels.append((k, int(k % 4 == 0)))
    found = toxicity.score_documents(spark.createDataFrame([*d, (1000, None), (1001, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == int(r["doc_key"] < 1000 and r["doc_key"] % 4 == 0) for r in found)
    for r in found:
        for s in r["sentences"]:
            assert "vilewort" in d[r["doc_key"]][1][s["start"] : s["end"]]


# --- tokens and packing -------------------------------------------------------------------------------------------------

STRANGE = ["<|endoftext|>", "a<|startoftext|>b", "don't WE'RE", "x  y z　w", "a\x1cb", "İstanbul", "é", "ΑΣ", "👍🏽", "1234567", "…“q”", "a\x85b c", "ǅ ŉ ﬁ", "word.", "Word,word", "ß!", "\x00", "ab​cd", "﻿ab"]


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(10**6 + k, t) for k, t in enumerate([*ODD, *STRANGE])]


def test_token_counts_are_the_librarys(spark, texts):
    library = Tokenizer.from_file(VOCABULARY)
    found = keyed(tokens.count_tokens(spark.createDataFrame(texts, "doc_id long, text string"), VOCABULARY))
    for k, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[k]["n_bytes"], found[k]["n_tokens"], found[k]["over_limit"]) == (len((t or "").encode()), n, n > 2048), t


def test_frequent_chunks_stay_in_memory(monkeypatch):
    """A word between rare ones is made once, however often the memory is full; marks behind letters are what the library makes of them."""
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    made, library, one = [], Tokenizer.from_file(VOCABULARY), tokens.Chunks.one
    monkeypatch.setattr(tokens.Chunks, "one", lambda self, piece: made.append(piece) or one(self, piece))
    chunks, rng = tokens.Chunks(VOCABULARY, tokens.prove_whole_tokens(VOCABULARY)), random.Random(4)
    words = [x for k in range(300) for x in ("Frequent", f"rare{''.join(rng.choices('abcdefgh', k=8))}{rng.choice(['', ',', '###', '...!', '<', '$$', '-'])}")]
    words += ["it's", "x'###", "a'", "é.", "Straße!?", "<|endoftext|>", "a<|endoftext|>", "ab12!!", "日本###", "#", "o" * 70 + "&&&", "e\u0301,"]
    assert chunks.ids(" ".join(words)) == tokens.pack(library.encode(" ".join(words), add_special_tokens=False).ids)
    assert made.count("frequent") == 1


def test_packing_holds_every_piece(spark, texts):
    library = Tokenizer.from_file(VOCABULARY)
    want = {}
    for k, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 2048):
            piece = ids[a : a + 2048]
            want[k, a // 2048] = (a, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)))
    found = queries.pack_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r["doc_key"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want
    assert len(found) == len(want)
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.02 * -(-sum(x[1] for x in want.values()) // 2048) + 1


def test_plan_uses_exact_complements():
    assert packing.plan({60: 2, 40: 2}, 100) == [((60, 40), 2)]
    assert packing.plan({60: 3, 30: 3, 10: 3}, 100) == [((60, 30, 10), 3)]
    assert packing.plan({40: 1, 30: 1, 20: 1, 10: 1}, 100) == [((40, 30, 20, 10), 1)]
    rng = random.Random(9)
    for _ in range(30):
        counts = {rng.randrange(1, 65): rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))}
        used = defaultdict(int)
        for lengths, times in packing.plan(counts, 64):
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] += times
        assert used == counts


# --- fingerprints -------------------------------------------------------------------------------------------------------


def test_edited_texts_and_equal_fingerprints(docs, rows):
    found = keyed(fingerprints.compare_with_edited(docs))
    prints = defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = found[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[text].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values())


def brute_sketch(spark, texts, words=5, fraction=8):
    """Shingles of lower-case words as tuples of their hashes, and of those the hashes that are low, and the least."""
    lists = [[w for w in t.lower().split() if w] for t in texts]
    rows = spark.createDataFrame([(w,) for w in sorted({w for x in lists for w in x})], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    h = {r["w"]: r["h"] for r in rows}
    shingles = sorted({tuple(h[w] for w in x[k : k + words]) for x in lists for k in range(len(x) - words + 1)})
    hashed = spark.createDataFrame([(list(x),) for x in shingles], "x array<long>").select("x", F.xxhash64(*[F.get("x", k) for k in range(words)]).alias("h")).collect()
    of = {tuple(r["x"]): r["h"] for r in hashed}
    out = []
    for x in lists:
        every = {of[tuple(h[w] for w in x[k : k + words])] for k in range(len(x) - words + 1)}
        out.append({v for v in every if v < -(1 << 63) + (1 << 64) // fraction} | ({min(every)} if every else set()))
    return out


def test_likeness_is_that_of_the_sketches(spark):
    """near_edited and near_next against sketches made by hand; texts of at least five words."""
    rng = random.Random(21)
    base = [prose(rng, rng.randrange(6, 300)) for _ in range(12)]
    texts = [rng.choice([t, near(rng, t, 0.1)]) for t in base for _ in range(3)]
    edited = []
    for k, t in enumerate(texts):
        half, after = len(t) // 2, texts[(k + 1) % len(texts)]
        edited.append(t[: len(t) - half] + after[:half])
    assert all(len(t.split()) >= 5 for t in edited)
    sketch, other = brute_sketch(spark, texts), brute_sketch(spark, edited)
    found = keyed(fingerprints.compare_with_edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    alike = lambda a, b: len(a & b) / len(a | b)
    for k in range(len(texts)):
        after = sketch[(k + 1) % len(texts)]
        assert set(map(int, found[k]["fingerprint"].split(","))) == sketch[k]
        assert set(map(int, found[k]["edited_fingerprint"].split(","))) == other[k]
        assert found[k]["near_edited"] == pytest.approx(alike(sketch[k], other[k]))
        assert found[k]["near_next"] == pytest.approx(alike(sketch[k], after))
        assert found[k]["contained_in_next"] == pytest.approx(len(sketch[k] & after) / len(sketch[k]))


def test_sketches_merge_and_tell_containment(spark):
    rng = random.Random(22)
    long, other = prose(rng, 4000), prose(rng, 3000)
    part = " ".join(long.split(" ")[500:1300])
    rows = spark.createDataFrame([(1, long), (2, part), (3, other), (4, long + " " + other), (5, "")], "doc_id long, text string")
    s = {r["doc_key"]: r["sketch"] for r in fingerprints.fingerprint(rows).collect()}
    pairs = spark.createDataFrame([(s[2], s[1], s[3], s[5])], "part array<long>, whole array<long>, other array<long>, none array<long>")
    a, b, c, e = (F.col(x) for x in ("part", "whole", "other", "none"))
    r = pairs.select(fingerprints.containment(a, b), fingerprints.containment(b, a), fingerprints.containment(a, c), fingerprints.containment(e, a), fingerprints.similarity(e, e), fingerprints.similarity(e, a), fingerprints.merged(b, c)).first()
    assert r[0] == 1.0 and abs(r[1] - 0.2) < 0.05 and r[2] == 0.0 and tuple(r[3:6]) == (1.0, 1.0, 0.0)
    assert r[6] == sorted(set(s[1]) | set(s[3])) and len(set(s[4]) ^ set(r[6])) <= 6  # shingles across the seam, and smallest hashes


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_successors_among_rows_of_one_id(spark, ranges):
    """Rows that share an id are dealt by their texts; every row has one successor, and all are one round."""
    rows = [(7 if k % 3 else k, f"text {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("s", F.col("t"))
    found = fingerprints.with_next(df, "k", "t", "s", ranges).collect()
    follow = {r["t"]: r["next_text"] for r in found}
    assert all(r["next_text"] == r["next_carried"] for r in found)
    at, seen = "text 0", []
    for _ in range(len(rows)):
        seen.append(at)
        at = follow[at]
    assert at == "text 0" and len(set(seen)) == len(rows)
    key = dict((t, k) for k, t in rows)
    order = [key[t] for t in seen]
    cut = order.index(min(order))
    assert order[cut:] + order[:cut] == sorted(order)


def test_sketch_estimates_jaccard(spark):
    rng = random.Random(5)
    a = prose(rng, 4000)
    pair = [(1, a), (2, near(rng, a, 0.03))]
    sets = [{tuple(t.split(" ")[k : k + 5]) for k in range(len(t.split(" ")) - 4)} for _, t in pair]
    s = {r["doc_key"]: r["sketch"] for r in fingerprints.fingerprint(spark.createDataFrame(pair, "doc_id long, text string")).collect()}
    estimate = len({*s[1]} & {*s[2]}) / len({*s[1]} | {*s[2]})
    assert abs(estimate - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.1


# --- similarity join ----------------------------------------------------------------------------------------------------


def brute_components(rows, words, similar):
    import re

    sets = {}
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
        sets[doc] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and similar[1] * common >= similar[0] * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize(("words", "similar", "chunk"), [(3, (90, 100), 2000), (5, (80, 100), 2000), (5, (80, 100), 4), (2, (1, 2), 7)])
def test_similarity_join_is_exact(docs, rows, words, similar, chunk):
    found = jaccard_join.link_components(docs, words=words, similar=similar, chunk_docs=chunk)
    assert {r["doc_key"]: (r["n_shingles"], r["component"]) for r in found.collect()} == brute_components(rows, words, similar)


def test_similarity_join_on_dense_near_copies(spark):
    """Chains of edits around the threshold: some pairs link, some do not."""
    rng = random.Random(12)
    rows, k = [], 0
    for _ in range(12):
        base = prose(rng, rng.randrange(10, 160))
        for _ in range(14):
            rows.append((k, base))
            k += 1
            base = near(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03]))
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similar=(80, 100), chunk_docs=20)
    assert {r["doc_key"]: (r["n_shingles"], r["component"]) for r in found.collect()} == brute_components(rows, 5, (80, 100))


def test_a_group_gives_no_more_rows_than_it_has(spark):
    """Documents that the bitmaps cannot tell apart: the group names its documents, not their pairs."""
    n = 200
    same = [np.full(1, 255, np.uint64)] * n
    doc = np.arange(n, dtype=np.int64)
    assert len(jaccard_join.join_group(doc, np.zeros(n, np.int64), doc, np.full(n, 8), same, None, (80, 100))) <= n
    rng = random.Random(21)  # a passage of 40 words and 8 to 12 words of their own: some pairs link, most do not
    passage = prose(rng, 40)
    rows = [(k, f"{passage} {prose(rng, rng.randrange(8, 13))}" if k % 3 else near(rng, passage, 0.02)) for k in range(150)]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similar=(80, 100), chunk_docs=40)
    assert {r["doc_key"]: (r["n_shingles"], r["component"]) for r in found.collect()} == brute_components(rows, 5, (80, 100))


# --- defined cases ------------------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc_key long, row string, score double"
CASES = [(None, "a text without an id", None, None, None, None, None, None), (5, None, None, None, None, 1, "x", 0.5), (6, "", "en", None, 0, 1, "x", 0.5), (7, "same rows here", "en", "s", 14, 1, "x", 0.5), (7, "same rows here", "en", "s", 14, 1, "x", 0.5), (8, "word " * 30_000, "en", "s", 150_000, 1, "x", 0.5)]


def every_operator(spark, d):
    bench = spark.createDataFrame([(1, "same rows here and more of them"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, None)], "doc_id long, toxic int")
    turns = d.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.col("lang").alias("role"), "text")
    return {
        "chat": chat_format.digest(chat_format.expand(turns)), "sharding": sharding.place(d, "doc_id"), "removal": substring_dedup.removal_digest(d), "dedup": substring_dedup.dedup(d),
        "leaks": decontamination.find_leaks(d, bench), "clean": decontamination.without_leaks(d, bench), "language": language_id.predict_languages(d), "identified": language_id.keep_identified(d),
        "tokens": tokens.count_tokens(d, VOCABULARY), "packing": queries.pack_documents(d), "fingerprints": fingerprints.compare_with_edited(d), "toxicity": toxicity.score_documents(d, labels),
        "links": jaccard_join.link_components(d), "one": jaccard_join.keep_one(d),
    }


def test_empty_tables(spark):
    for name, df in every_operator(spark, spark.createDataFrame([], SCHEMA)).items():
        assert df.collect() == [], name


def test_odd_rows_and_clashing_columns(spark):
    d = spark.createDataFrame(CASES, SCHEMA)
    found = {name: df.collect() for name, df in every_operator(spark, d).items()}
    for name in ("sharding", "removal", "dedup", "language", "tokens", "fingerprints", "toxicity", "links"):
        assert len(found[name]) == len(CASES), name
    assert {r["doc_key"] for r in found["removal"]} == {NO_ID, 5, 6, 7, 8}
    assert len(found["one"]) == 5
    for name in ("dedup", "clean", "identified", "one"):
        assert not found[name] or found[name][0].asDict().keys() == set(d.columns), name
