"""Training-data operators against brute force and exact round trips, on rows that cover the odd cases."""

import hashlib
import itertools
import random
import re
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from contrasieve.llm import _tokens, chat, decontaminate, packing, quality_mcd, recompression, sharding, suffix_dedup, token_coder, warc, weighted_minhash
from contrasieve.llm._scan import raw
from contrasieve.llm._stats import COUNTS, with_counts
from contrasieve.llm._tokens import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgéüß") for _ in range(rng.randint(1, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" ", " ", " ", "\n", ", ", "  "]) for _ in range(n))


PASSAGE = prose(120, 99)
LONG = prose(30_000, 7)
TEXTS = [
    (1, prose(150, 1)), (2, prose(150, 1)), (3, prose(60, 3) + PASSAGE + prose(40, 4)), (4, PASSAGE + prose(50, 5)), (5, None), (6, ""),
    (7, "aaaa " * 300), (8, "a" * 700), (9, LONG), (10, prose(20, 11) + LONG[500:9000]), (11, "one two three"), (12, "one two three"),
    (13, prose(100, 20)), (14, prose(100, 20).replace(" ", " ", 1) + "end"), (15, " \t\n "), (16, "x \n y　 z <|endoftext|> ok"), (17, "word " * 2000),
    (18, PASSAGE), (19, PASSAGE), (20, prose(99, 30) + "\n" + prose(99, 30)),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc bigint, size bigint, bucket string"


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns bear names that the operators use inside
    rows = [(i, t, "en" if i % 2 else None, "s", None, 1, 2, "b") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def rows_by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def removed_bytes(texts, length):
    seen, out = set(), {}
    for d, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_family_removes_what_starts_earlier(docs):
    got = rows_by(suffix_dedup.drop_repeats(docs), "doc_id")
    for d, want in removed_bytes(TEXTS, 100).items():
        assert tuple(got[d][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want, d
    assert len(got) == len(TEXTS)


def removed_words(texts, length):
    tokens = {d: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for d, t in texts}
    first = {}
    for d in sorted(tokens):
        for i in range(len(tokens[d]) - length + 1):
            first.setdefault(tuple(tokens[d][i : i + length]), d)
    out = {}
    for d, w in tokens.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_recompression_removes_what_smaller_documents_have(docs):
    got = rows_by(recompression.drop_repeats(docs), "doc_id")
    for d, want in removed_words(TEXTS, 50).items():
        assert tuple(got[d][c] for c in ("n_words", "n_removed", "kept_sha256")) == want, d
    assert got[13]["kept"] == dict(TEXTS)[13]


# null and repeated ids; what row 2 repeats stands at places where rows 3 and 4 repeat nothing
SHARED = [
    (None, prose(100, 70)), (None, prose(30, 71) + prose(100, 70)), (None, prose(200, 72)),
    (3, prose(40, 73) + prose(90, 70)), (3, prose(200, 74)), (3, prose(200, 75)), (4, prose(200, 75)), (4, None), (4, prose(200, 75)),
]


@pytest.fixture(scope="module")
def shared(spark):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in SHARED]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


def in_rows():
    """Rows of SHARED as they stand for ``own_keys``: by id, and then by each order of equal ids."""
    groups = [[(d, t) for d, t in SHARED if d == k] for k in (None, 3, 4)]
    for order in itertools.product(*(itertools.permutations(g) for g in groups)):
        yield list(enumerate(itertools.chain(*order)))


def test_rows_that_share_an_id_keep_their_own_text(shared):
    for module, width, brute in ((recompression, 50, removed_words), (suffix_dedup, 100, removed_bytes)):
        got = sorted((-1 if r[0] is None else r[0], r["n_removed"], r["kept_sha256"]) for r in module.drop_repeats(shared).collect())
        told = []
        for rows in in_rows():
            want = brute([(k, t) for k, (_, t) in rows], width)
            told.append(sorted((-1 if d is None else d, want[k][-3 if brute is removed_bytes else -2], want[k][-1]) for k, (d, _) in rows))
        assert got in told


def test_near_copies_tell_rows_of_one_id_apart(shared):
    got = Counter((r["doc_id"], r["same_text"], r["class_id"]) for r in weighted_minhash.near_copies(shared).collect())
    copies = {t for _, t in SHARED if t == prose(200, 75)}
    assert len(copies) == 1 and sum(got.values()) == len(SHARED)
    assert got[4, 3, 3] == 2 and got[4, 4, 4] == 1 and got[3, 3, 3] == 3


def test_pipeline_stages_judge_each_row_by_its_own_text(spark, shared):
    cut = corpus_pipeline.substrings(spark, shared, "").collect()
    assert len(cut) == len(SHARED) and all(r["n_chars"] == len(r["text"] or "") for r in cut)
    texts = Counter(r["text"] for r in cut)
    assert texts[prose(200, 72)] == 1 and texts[prose(200, 74)] == 1 and texts[prose(200, 75)] == 1
    only = corpus_pipeline.near_copies(spark, shared, "").collect()
    assert Counter(r["text"] for r in only) >= Counter({prose(200, 72): 1, prose(200, 74): 1, prose(200, 75): 1})


def test_symbols_do_not_depend_on_what_surrounds_them():
    r = np.random.default_rng(1)
    core = r.integers(0, 6, 300).astype(np.uint64)
    seen = []
    for seed in (2, 3):
        around = np.random.default_rng(seed).integers(0, 6, 40).astype(np.uint64)
        whole = np.concatenate([around, core, around[::-1]])
        name, start, size = recompression.symbols(whole, np.zeros(len(whole), np.int64))
        inside = (start >= 40 + recompression.MARGIN) & (start + size <= 340 - recompression.MARGIN)
        seen.append(set(zip(name[inside].tolist(), (start[inside]).tolist())))
        assert size.max() <= recompression.LONGEST
    assert seen[0] == seen[1]


def near(a, b, edits):
    """Smallest number of edits that puts all of ``a`` somewhere in ``b``."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) <= edits


def test_decontamination_finds_edited_items(spark):
    item = prose(45, 50)
    n = len(re.sub(r"[\W_]+", " ", item.lower()).strip())
    budget = int(decontaminate.RATE * n)
    r = random.Random(8)

    def edited(k):
        chars = list(item)
        for p in r.sample([i for i, c in enumerate(chars) if c.isalpha()], k):
            chars[p] = "q"
        return "".join(chars)

    texts = {1: prose(30, 60) + item + prose(20, 61), 2: prose(30, 62) + edited(budget) + prose(30, 63), 3: "zz " + edited(budget + 6) + prose(9, 64), 4: prose(300, 65), 5: None, 6: "", 7: "ab", 8: item.replace(" ", " - ")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, " . "), (4, "qqqqqq wwwwww")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(docs, bench).collect()}
    clean = {d: re.sub(r"[\W_]+", " ", (t or "").lower()).strip() for d, t in texts.items()}
    want = {(d, 1) for d in texts if near(re.sub(r"[\W_]+", " ", item.lower()).strip(), clean[d], budget)}
    assert set(got) == want and {(1, 1), (2, 1), (8, 1)} <= want and (3, 1) not in want
    hit = got[1, 1]
    assert re.sub(r"\W+", " ", texts[1][hit["begin"] : hit["end"]].lower()).strip() == re.sub(r"\W+", " ", item.lower()).strip()
    assert got[2, 1]["edits"] <= budget


def test_shards_are_even_and_keep_equal_texts_together(docs):
    got = sharding.shard(docs).collect()
    sizes = {d: len((t or "").encode()) + 1 for d, t in TEXTS}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    assert all(r["text_crc32"] == zlib.crc32((dict(TEXTS)[r["doc_id"]] or "").encode()) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_balance(spark):
    rows = [(i, "same " * 30 if i % 3 == 0 else prose(5 + i % 40, i)) for i in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    load = Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in got)


@pytest.mark.parametrize("copies", [2, 60])
def test_groups_that_fit_are_whole_where_all_are_copies(spark, copies):
    rows = [(i, prose(5 + i // copies % 40, i // copies)) for i in range(2400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    where, load, group = defaultdict(set), Counter(), Counter()
    for r in got:
        where[r["doc_id"] // copies].add(r["shard"])
        load[r["shard"]] += r["size"]
        group[r["doc_id"] // copies] += r["size"]
    assert max(group.values()) <= sum(load.values()) / 8 and all(len(s) == 1 for s in where.values())
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= max(group.values())


def test_bigger_groups_take_what_room_is_left(spark):
    rows = [(i, "a" * 99) for i in range(300)] + [(300 + i, "b" * 99) for i in range(70)] + [(370 + i, f"c{i // 3:02}" * 33) for i in range(30)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=4).collect()
    where, load = defaultdict(set), Counter()
    for r in got:
        where[dict(rows)[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert sum(len(s) > 1 for s in where.values()) == 1 and max(load.values()) - min(load.values()) <= 200


def test_token_file_round_trip(spark, docs, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    token_coder.write(docs, f"{tmp_path}/ids", path)
    got = rows_by(token_coder.read(spark, f"{tmp_path}/ids"), "doc_id")
    tokenizer, at = tokenizers.Tokenizer.from_file(path), 0
    for d, t in sorted(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[d] == {"doc_id": d, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}, d
        at += len(ids)


@pytest.mark.parametrize("n, kinds", [(1, 3), (2047, 1), (2048, 7), (2049, 40_000), (9000, 50)])
def test_coder_blocks_are_exact(n, kinds):
    ids = (np.random.default_rng(n).zipf(1.4, n) % kinds).astype(np.uint32)
    base = token_coder.base_frequencies(ids)
    assert (token_coder.decode(token_coder.encode(ids, *base), n, *base) == ids).all()


CONTROL = "<|im_end|>\n<|im_start|>assistant &lt;|x|> &amp; ok"


def test_chat_windows_round_trip(spark):
    rows = [(1, t, r, prose(200, t)) for t, r in enumerate(["system", *["user", "assistant"] * 12])]
    rows += [(2, 0, "user", CONTROL), (2, 1, "assistant", CONTROL), (3, 0, "system", None), (None, 1, "assistant", "x"), (4, 7, None, "a\nb"), (4, 7, None, "a\nb"), (4, None, "assi\nstant", "c"), (5, 0, "assistant", prose(3000, 3))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.windows(turns, tokenizer_path("byte_bpe_50k.json"))
    got = rows_by(chat.read_back(made), "conv_id")
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for *_, r, x in ts if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in ts).encode()).hexdigest()), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = made.where("conv_id = 1").collect()
    assert len(windows) > 2 and all(w["text"].startswith("<|im_start|>system") for w in windows)


def test_chat_windows_fill_the_budget(spark, monkeypatch):
    monkeypatch.setattr(chat, "SECTION", 64)  # sections end inside the long conversation
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant"]), prose(r.randint(5, 30), t)) for t in range(600)]
    rows += [(2, t, "assistant", "&<|" * r.randint(1, 90)) for t in range(60)]  # text that grows when escaped
    rows += [(3, 0, "system", prose(60, 1)), *((3, t, "us\ner", prose(r.randint(1, 80), t)) for t in range(1, 90))]
    rows += [(4, 0, "system", prose(40, 2)), (4, 1, "user", prose(900, 3)), (4, 2, "assistant", "short"), (4, 3, "user", prose(20, 4))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    made = defaultdict(list)
    for w in chat.windows(turns, path).orderBy("conv_id", "window").collect():
        shown = w["text"].split(chat.END)[:-1]
        made[w["conv_id"]].append((len(whole.encode(w["text"], add_special_tokens=False).ids), shown[: w["repeated"]], shown[w["repeated"] :]))
    for conv in (1, 2, 3):
        sizes = [n for n, _, _ in made[conv]]
        assert max(sizes) <= chat.MAX_TOKENS
    full = [n for n, _, _ in made[1]]
    assert sum(full) / len(full) > 0.85 * chat.MAX_TOKENS
    for conv, windows in made.items():  # each turn is new once, in order; what repeats are the turns just before
        before = []
        lead = [f"{chat.START}{r}\n{x}" for c, t, r, x in rows if c == conv and t == 0 and r == "system"]
        for i, (n, repeated, fresh) in enumerate(windows):
            assert fresh and (i == 0 or repeated[: len(lead)] == lead)
            history = repeated[len(lead) if i else 0 :]
            assert len(history) <= chat.HISTORY_TURNS and before[len(before) - len(history) :] == history
            before += fresh
        assert len(before) == sum(c == conv for c, *_ in rows)
    assert [n > chat.MAX_TOKENS for n, _, _ in made[4]] == [True, False]  # only the turn that fits nowhere exceeds


def weighted_classes(texts, sketch, n):
    idf = weighted_minhash.inverse_frequencies(sketch, n)
    vectors = {}
    for d, t in texts:
        _, value, count = weighted_minhash.shingles(*raw(pa.array([t], pa.string())))
        vectors[d] = value, weighted_minhash.weights(value, count, idf)
    parent = {d: d for d, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(texts, 2):
        if (x or "") == (y or "") or weighted_minhash.similarity(vectors[a], vectors[b]) >= weighted_minhash.SIMILARITY:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in texts}


def test_near_copies_equal_all_pairs(spark, docs):
    base = prose(400, 70).split(" ")
    more = [(100 + k, " ".join(w if random.Random(k * 1000 + i).random() > 0.015 else "zz" for i, w in enumerate(base))) for k in range(25)]
    texts = TEXTS + more
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_copies(table).collect()}
    assert got == weighted_classes(texts, *weighted_minhash.document_frequencies(table, "text"))


def test_packing_is_exact_and_dense(docs):
    path = tokenizer_path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path).collect()
    tokenizer = tokenizers.Tokenizer.from_file(path)
    by, bins, total = defaultdict(list), defaultdict(list), 0
    for r in got:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for d, t in TEXTS:
        ids, at = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            assert k == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids)
        total += at
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 1


def test_local_search_empties_a_bin():
    bins = packing.Search([600, 300, 500, 500, 424, 100, 624], [[0, 1], [2, 5], [3], [4], [6]], 1024).run(5)
    assert len(bins) == 3 and sorted(itertools.chain(*bins)) == list(range(7))


def plain_counts(s):
    s = s or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, again = set(), 0
    for line in s.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", s)), again, len(hit)


def test_counts_of_whole_texts(docs):
    got = rows_by(with_counts(docs, "doc_id", "text"), "doc_id")
    assert {d: tuple(got[d][c] for c in COUNTS) for d, _ in TEXTS} == {d: plain_counts(t) for d, t in TEXTS}


def test_quality_rejects_outliers_and_keeps_clean_rows(spark, docs):
    rows = [(i, prose(80 + i % 90, 500 + i), "en", "s") for i in range(200)]
    rows += [(1000 + i, prose(100, 900 + i).replace(" ", "### "), "en", "s") for i in range(12)]
    got = rows_by(quality_mcd.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")), "doc_id")
    assert all(got[i]["kept"] for i in range(200)) and not any(got[1000 + i]["kept"] for i in range(12))
    few = rows_by(quality_mcd.judge(docs), "doc_id")
    assert not few[5]["kept"] and few[5]["base_failed"] and few[1]["kept"] and len(few) == len(TEXTS)


def test_chi_square_quantiles():
    assert abs(quality_mcd.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality_mcd.chi2_cdf(6.6257, 5) - 0.75) < 1e-4


def test_archives_round_trip(spark, tmp_path):
    body = "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>"
    rows = [(1, "http://www.a.org/x", body), (2, "https://b.org:443/", body), (3, None, None), (4, "http://a.org/x", ""), (5, "http://[bad", "z"), (None, "http://c.org", "y"), (7, "http://c.org ", "y")]
    got = warc.capture_histories(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"{tmp_path}/w").collect()
    firsts = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        firsts.setdefault(r[2] or "", r[0])
    import base64

    for r in got:
        payload = next(x[2] for x in rows if x[0] == r["page_id"]) or ""
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        assert (r["payload_bytes"], r["record_type"]) == (len(payload.encode()), "response" if firsts[payload] == r["page_id"] else "revisit")
        assert r["refers_to"] == (None if r["record_type"] == "response" else firsts[payload])
    assert len(got) == len(rows)


def test_loser_tree_merges():
    r = random.Random(3)
    runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 9))) for _ in range(7)]
    assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(itertools.chain(*runs))
    assert list(warc.LoserTree([])) == []


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    assert suffix_dedup.drop_repeats(none).isEmpty() and recompression.drop_repeats(none).isEmpty()
    assert decontaminate.find(none, bench).isEmpty() and sharding.shard(none).isEmpty()
    assert weighted_minhash.near_copies(none).isEmpty() and packing.pack_documents(none, path).isEmpty() and quality_mcd.judge(none).isEmpty()
    assert chat.read_back(chat.windows(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"), path)).isEmpty()
    token_coder.write(none, f"{tmp_path}/t", path)
    assert token_coder.read(spark, f"{tmp_path}/t").isEmpty()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_have_the_ids_of_whole_texts(name, monkeypatch):
    parts = [*"aBst'.,!?;: \n\t\r1-_|", "<|endoftext|>", "<|startoftext|>", "é", "é", "́", "Σ", "İ", "２", " ", "　", " ", "中", "🙂", "‍", "\x85", "\x1c", "ﬁ", "ll"]
    parts += [*"×÷ßÿÀñ#$%&*()ſº", " the", " der", " 's", " don't", " que", "\nund"]  # signs after letters, words that are encoded together
    r = random.Random(6)
    texts = [None, "", *("".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000))]
    whole = tokenizers.Tokenizer.from_file(tokenizer_path(name))
    expected = [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    monkeypatch.setattr(_tokens, "_process", lambda store=types.ModuleType("fresh"): store)
    monkeypatch.setattr(_tokens, "REMEMBERED", 500)  # fewer than there are pieces
    encoder = _tokens.Encoder(tokenizer_path(name))
    for _ in range(2):  # pieces unknown, then some of them known
        ids, ends = encoder.column(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(ends)] == expected
        assert 0 < len(encoder.store.known) <= 500
