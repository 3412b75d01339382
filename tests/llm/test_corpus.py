"""The corpus operators on odd rows (null, empty, very long, repeated, clashing columns, empty
tables) and against brute force where SQL has no say."""

import hashlib
import io
import itertools
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import chat, decontaminate, licenses, line_dedup, minhash, mixing, pii, quality, queries, toxicity, warc
from strata.llm.components import components

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 20_000
WORDS = [f"w{i}" for i in range(300)]


def text_of(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, "one", "b"), (6, text_of(6), "b"), (6, text_of(6), "b"),
       (None, text_of(6), None), (None, None, None), (7, text_of(6) + " x", "a"), (8, "é" * 50_000, "a"), (9, "x" * 100_000, "c")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with further columns named like the operators' own."""
    extra = {c: F.lit(f"own {c}") for c in ("kept", "n_words", "size", "taken", "row", "h", "key", "component_id", "words", "line")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def run_all(spark, docs):
    items = spark.createDataFrame([(1, "one"), (2, text_of(6)[:80]), (3, None), (None, "one"), (1, "one")], "item_id long, text string")
    model = toxicity.train(["bad word here", "bad bad thing", "good word", "nice good thing"], [1, 1, 0, 0], steps=5, rounds=1)
    slim = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"), F.lit(None).cast("double").alias("quality"))
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("source").alias("role"), "text")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    return {"quality": quality.annotate(docs), "lines": line_dedup.dedup(docs), "near": minhash.near_duplicates(docs),
            "contamination": decontaminate.contamination(docs, items), "licenses": licenses.scan(docs),
            "toxicity": toxicity.score(docs, model), "pii": pii.find(docs), "mix": mixing.mix(slim),
            "warc": warc.read_archives(warc.write_archives(pages)),
            "chat": chat.format_chats(turns)}


@pytest.fixture(scope="module")
def odd_results(spark, odd):
    return {k: df.collect() for k, df in run_all(spark, odd).items()}


def test_every_row_of_odd_input_has_a_result(odd_results):
    assert {k: len(v) for k, v in odd_results.items()} == dict.fromkeys(odd_results, len(ODD))


def test_empty_tables_give_empty_results(spark, empty):
    assert {k: df.count() for k, df in run_all(spark, empty).items()} == dict.fromkeys(run_all(spark, empty), 0)


def test_odd_rows_quality(odd_results):
    by = {r.doc_id: r for r in odd_results["quality"]}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and not by[1].kept
    assert by[4].n_words == 100_000 and by[4].base_failed and by[6].n_words == 120
    assert by[1].source == "a" and by[1].row == "own row"


def test_odd_rows_near(odd_results):
    by = {r.doc_id: r for r in odd_results["near"]}
    assert by[7].component_id == 6 and not by[7].kept and by[6].kept
    assert [by[i].n_shingles for i in (1, 2, 3, 5)] == [0, 0, 0, 1]
    assert all(by[i].component_id == i for i in (1, 2, 3, 5)) and by[None].component_id is None


def test_odd_rows_lines_and_mix(odd_results):
    lines = [r for r in odd_results["lines"] if r.doc_id == 6]
    # the null id comes first in the order, so its equal text is the earlier match
    assert len(lines) == 2 and {r.n_removed for r in lines} == {1} and lines[0].line == "own line"
    assert [r.text for r in odd_results["lines"] if r.doc_id == 1] == [None]
    mix = odd_results["mix"]
    for source in ("a", "b", "c", None):
        rows = [r for r in mix if r.source == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
        assert all(r.taken <= 3 * r.size for r in rows)
    assert sum({r.source: r.target for r in mix}.values()) == pytest.approx(sum(r.size for r in mix))


def test_targets_cap_and_reshare(spark):
    rows = [("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 90)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    # weights 5 2 1 5 2; a and d are held at three times their size; null too; b and c share the rest 2 : 1
    assert got["a"] == 30 and got["d"] == 0 and got[None] == 270
    assert got["b"] == pytest.approx(1200) and got["c"] == pytest.approx(600)


def test_components_match_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(0, i) for i in range(300, 340)] + [(i, i + 1) for i in range(400, 430)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: find(i) for i in {x for e in edges for x in e} if find(i) != i}


def test_near_duplicates_match_brute_force(spark):
    base = [text_of(i).split() for i in range(25)]
    r = random.Random(1)
    texts = [" ".join(w) for w in base]
    for _ in range(200):  # copies with up to a dozen changed words: similarities on both sides of 0.8
        w = list(r.choice(base[:6]))
        for _ in range(r.randrange(13)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    sets = [{tuple(w[j:j + 4]) for j in range(len(w) - 3)} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    out = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in out} == {i: find(i) for i in range(len(texts))}
    assert {x.doc_id: x.n_shingles for x in out} == {i: len(z) for i, z in enumerate(sets)}


def test_toxicity_generalises_to_misspellings():
    r = random.Random(2)
    bad = ["idiot", "moron", "stupid", "scumbag"]
    texts, labels = [], []
    for i in range(400):
        w = [r.choice(WORDS) + r.choice(["ing", "ed", "s", ""]) for _ in range(60)]
        if i % 4 == 0:
            w[r.randrange(60)] = r.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels)
    score = lambda t: model.scores([t], {})[0]
    clean = text_of(99)
    assert score(clean) < 0.5 and score("") <= 0.5 and score(None) <= 0.5
    assert score(clean + " idiiot " + clean) > score(clean) and score(clean + " stupidd") >= 0.7


def test_op2_is_right_on_held_out_documents(spark):
    out = queries.QUERIES["op2_toxicity"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_pii_base_matches_plain_patterns():
    def brute(text):
        out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m.group())
            if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
                out.append((*m.span(), "card"))
        out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["a", "B", "1", "2", "255", "4929348385146306", "@", ".", "+1", " ", "-", "(", "x.y", "%", "\n", "é"]) for _ in range(r.randrange(40)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_viterbi_is_the_best_path_and_training_learns():
    rng = np.random.default_rng(0)
    e, moves = rng.normal(size=(3, 5, 6)), rng.normal(size=(6, 6))
    lengths = np.array([5, 4, 1])
    tags = pii.viterbi(np.where(np.arange(5)[None, :, None] < lengths[:, None, None], e, 0), lengths, moves)
    for row, n in enumerate(lengths):
        best = max(itertools.product(range(6), repeat=int(n)), key=lambda p: sum(e[row, i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)))
        assert tuple(tags[row, :n]) == best
    field = pii.train()
    decoder = pii.Decoder(field)
    (base, added), = decoder.spans(["call 415-555-0199 or\nlogin with password=abc123def456 and a plain word"])
    assert not base and {s[2] for s in added} == {"phone", "secret"}
    assert decoder.spans(["Is ednt thon thheer thst", "the of and to 1999"]) == [([], []), ([], [])]


def test_op9_matches_its_operator_by_hand(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_personal_data"](spark, SF).collect():
        base = pii.base_spans(docs[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pii.KINDS[:4]]


def test_zip_reader_follows_zip64_and_comments(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    body = warc.gzip.compress(warc.record("7", "http://x/é", "päy".encode()))
    data = warc._pack([(body, "http://x/é")])
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"a comment PK\x05\x06 with a false end"
    data = out.getvalue()
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    package = warc.Package(io.BytesIO(data), len(data))
    (r,) = package.records()
    assert (r["page_id"], r["payload"].decode(), r["record_type"]) == ("7", "päy", "response")
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(b"no archive"), 10)


def test_warc_odd_rows(odd_results):
    rows = odd_results["warc"]
    assert sorted(r.payload_bytes for r in rows if r.payload_bytes == 0) == [0, 0, 0]
    empties = [r for r in rows if r.payload_bytes == 0]
    assert {r.page_id: (r.record_type, r.refers_to) for r in empties} == {"1": ("response", None), "2": ("revisit", "1"), None: ("revisit", "1")}
    assert [r.record_type for r in rows if r.page_id == "6"] == ["response", "response"]


def test_chat_escapes_reversibly():
    r = random.Random(5)
    for _ in range(2000):
        text = "".join(r.choice(["<", "s>", "/s>", "[", "INST]", "/INST]", "\\", "a", "é"]) for _ in range(r.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(m in chat.escape(text) for m in chat.MARKS)


def test_chat_masks_and_offsets(odd_results, spark):
    turns = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "yes [INST]"), (1, 2, "assistant", None)]
    rows = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    codec = chat.Codec(chat.VOCABULARY)
    assert [r.starts_at for r in rows] == [0, len(rows[0].ids), len(rows[0].ids) + len(rows[1].ids)]
    assert all(r.n_tokens == len(r.ids) == len(r.mask) for r in rows)
    learned = [i for i, m in zip(rows[1].ids, rows[1].mask) if m]
    assert chat.unescape(codec.decode(np.array(learned))) == "yes [INST]" and not any(rows[0].mask) and not any(rows[2].mask)


def test_decontamination_of_short_items(spark):
    docs = [(1, "The One, two"), (2, "zero one two three"), (3, None), (4, "one"), (5, text_of(1, 400))]
    items = [("b", "one two"), ("a", "ONE"), ("n", None), ("c", " ".join(text_of(1, 400).split()[40:53])), ("d", "nothing here")]
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in out.collect()}
    assert got == {1: (3, 2, ["a", "b"], True), 2: (4, 2, ["a", "b"], True), 3: (0, 0, [], False), 4: (1, 1, ["a"], True),
                   5: (400, 13, ["c"], False)}


def test_decontamination_shuffles_a_large_benchmark_to_the_same_result(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (decontaminate.contamination(docs, items, broadcast_rows=n).orderBy("doc_id").collect() for n in (200_000, 0))
    assert a == b


def test_line_dedup_shuffles_to_the_same_result(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = line_dedup.dedup(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert a == line_dedup.dedup(docs).orderBy("doc_id").collect()


def brute_lines(spark, docs, shingle=5, percent=80):
    """(doc_id, text, lines with a word, removed) of each row, by all pairs of lines."""
    texts = spark.createDataFrame([(t,) for _, t in docs], "t string").select("t", line_dedup.text_key(F.col("t")).alias("h"))
    digest = {r.t: tuple(r.h) for r in texts.collect()}  # the order of texts of one id
    lines = []
    for d, t in docs:
        for i, s in enumerate((t or "").split("\n")):
            w = re.sub(r"[\t\v\f\r]", " ", s).lower().split(" ")
            w = [x for x in w if x]
            if w:
                grams = {tuple(w[j:j + shingle]) for j in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)}
                lines.append(((d is not None, d or 0, digest[t], i), grams))
    lines = sorted({k: g for k, g in lines}.items())
    gone = set()
    for x, (key, g) in enumerate(lines):
        for _, h in lines[:x]:
            both = len(g & h)
            if 100 * both >= percent * (len(g) + len(h) - both):
                gone.add(key)
                break
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        keys = [(d is not None, d or 0, digest[t], i) for i in range(len(own))]
        stay = [s for k, s in zip(keys, own) if k not in gone]
        out.append((d, None if t is None else "\n".join(stay), sum(bool(s.strip(" \t\v\f\r")) for s in own), sum(k in gone for k in keys)))
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(4)
    base = [text_of(f"line{i}", r.randrange(1, 40)) for i in range(25)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(r.randrange(1, 6)):
            w = r.choice(base).split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            own.append(r.choice([" ", "  ", "\t"]).join(w).upper() if r.random() < .1 else " ".join(w))
        docs.append((r.randrange(40) if r.random() < .9 else None, "\n".join(own + [" \t"] * r.randrange(2))))
    docs += docs[:5] + [(1, None), (2, "")]
    out = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, out), key=str) == sorted(brute_lines(spark, docs), key=str)


def test_line_dedup_tells_texts_of_one_id_and_one_short_hash_apart(spark):
    many = spark.range(300_000).select(F.concat(F.lit("text number "), "id").alias("t"))
    one, two = many.groupBy(F.hash("t").alias("h")).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("a", "b").first()
    docs = [(1, f"{one}"), (5, one), (5, two), (None, one), (None, two)]
    out = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == sorted(brute_lines(spark, docs), key=str)


def test_line_dedup_takes_matched_lines_out_without_joining_all_lines(spark):
    near = text_of("near", 30).split()
    docs = [(1, " ".join(near)), (2, " ".join([*near[:-1], "other"])), (None, "one line of its own"), (3, "one line of its own"), (4, None)]
    kept = line_dedup.kept_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert "LeftAnti" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.lines for r in kept.collect()} == {None: [0], 1: [0], 2: []}


def test_line_dedup_sorts_tokens_in_compiled_code_and_counts_each_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "written", lambda df, name: df)
    docs = [(1, " ".join(["a b c d e f g"] * 9)), (2, "one two"), (3, text_of("x", 30)), (4, "one two three four five six"), (5, None)]
    firsts = line_dedup.first_lines(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80)
    inside = r"(sort_array|array_distinct)\([^)]*lambda"  # by functions of items these run without compiled code
    assert not re.search(inside, firsts._jdf.queryExecution().optimizedPlan().toString())
    rows = {r.doc_id: (r.size, len(r.least), len(set(r.least))) for r in firsts.collect()}
    assert rows == {1: (7, 4, 4), 2: (1, 1, 1), 3: (26, 8, 8), 4: (2, 2, 2)}


def test_line_dedup_emits_few_pairs_for_a_phrase_of_many_lines(spark, monkeypatch):
    phrase = "all rights reserved by the owner of this page since then and for all time"
    docs = [(i, f"{text_of(i, 30)} {phrase}" if i % 2 else f"{phrase} {text_of(i, 25)}") for i in range(10_000)]
    pairs = []
    kept = line_dedup.written

    def counting(df, name):
        out = kept(df, name)
        if name == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counting)
    out = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert out.agg(F.sum("n_removed")).first()[0] == 0 and sum(pairs) < 100


def test_mix_is_the_same_for_any_bins(spark):
    slim = queries.with_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    a, b = (mixing.mix(slim, bins=n).orderBy("doc_id").collect() for n in (1, 1024))
    assert a == b


# --- the pipeline ------------------------------------------------------------------------------------
def brute_pipeline_step(name, before, items):
    """Ids that a stage leaves, by plain Python."""
    if name == "decontamination":
        cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        wins = set()
        for t in items:
            w = cut(t)
            wins |= {tuple(w[i:i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
        sizes = {len(w) for w in wins}
        left = set()
        for i, t in before.items():
            w = cut(t)
            hit = {p for n in sizes for s in range(len(w) - n + 1) if tuple(w[s:s + n]) in wins for p in range(s, s + n)}
            if not (hit and 20 * len(hit) >= len(w)):
                left.add(i)
        return left
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.encode().lower().split()) for i, t in before.items())}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name in ("near_duplicates", "decontamination"):
            assert set(after) == brute_pipeline_step(name, {i: r.text for i, r in before.items()}, items)
        if name in ("quality_rules", "near_duplicates", "decontamination"):
            assert all(after[i] == before[i] for i in after)
        if name == "line_dedup":
            assert all(after[i].n_chars == len(after[i].text) for i in after if after[i].text != before[i].text)
        if name == "mixing":
            assert all(r.taken > 0 for r in after.values())
            for source in {r.source for r in before.values()}:
                rows = [r for r in after.values() if r.source == source]
                assert not rows or abs(sum(r.taken for r in rows) - rows[0].target) <= 1


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count()
        corpus_pipeline.mixing_stage(spark, docs, SF).count()
    near = corpus_pipeline.near_duplicate_stage(spark, odd, SF).collect()
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 8, 9]


# --- licence notices within longer lines and paragraphs ------------------------------------------------
def licences_of(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [(m.license, round(m.dice, 6)) for m in r.licenses] for r in rows}


def test_licences_within_lines_and_wrapped(spark):
    filler = text_of(3, 60)
    gpl = licenses.TEMPLATES["GPL-3.0"]
    header = licenses.TEMPLATES["Apache-2.0-header"]
    got = licences_of(spark, [
        "This project is released under the MIT License (see LICENSE).",
        f"{filler} Released under the MIT License. {filler}",
        f"{text_of(4, 7)} {gpl} {text_of(5, 7)}",
        gpl.replace("the GNU", "the\nGNU") + f"\n{filler}",
        "# " + header.replace("\n", "\n# ") + f"\n{filler}",
        "Released under the MIT License.\n" + filler,
        f"{filler} Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n{filler} released under the MIT license {filler}",
        f"{filler} under the license {filler} the MIT {filler}"])
    assert got[0] == got[1] == [("MIT", 1.0)] and got[2] == got[3] == [("GPL-3.0", 1.0)]
    assert ("Apache-2.0-header", 1.0) in got[4] and got[5] == [("MIT", 1.0)] and got[7] == []
    assert got[6] == [("CC-BY-NC-4.0", 1.0), ("MIT", 1.0)]


def test_best_runs_match_brute_force(spark):
    r, known = random.Random(8), {k: licenses.TEMPLATES[k] for k in ("Apache-2.0", "CC-BY-4.0", "GPL-3.0", "MIT")}
    texts = []
    for _ in range(60):
        w = licenses.template_words(r.choice(sorted(known.values())))
        for _ in range(r.randrange(4)):
            w.insert(r.randrange(len(w)), r.choice(WORDS + ["the", "license"])) if r.random() < 0.5 else w.pop(r.randrange(len(w)))
        texts.append(" ".join(text_of(r.random(), 5).split() + w + text_of(r.random(), 5).split()))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=known).collect()
    for row in rows:
        w, best = licenses.template_words(row.text), {}
        for name, body in known.items():
            own = set(licenses.template_pairs(licenses.template_words(body)))
            for a, b in itertools.combinations(range(len(w) + 1), 2):
                run = set(licenses.template_pairs(w[a:b])) if b - a > 1 else set()
                best[name] = max(best.get(name, 0), 2 * len(run & own) / (len(run) + len(own)))
        got = {}
        for m in row.licenses:
            got[m.license] = max(got.get(m.license, 0), m.dice)
        assert got == pytest.approx({k: v for k, v in best.items() if v >= 0.8})


WHOLE = ["Apache-2.0-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "CC0-1.0-text", "GPL-3.0-text", "ISC-text", "MIT-text",
         "MPL-2.0-text", "Unlicense-text"]


def test_whole_licence_texts_alone_before_code_and_in_comments(spark):
    code = "\nint main(void) {\n  return 0;\n}\n" * 40
    bodies = [licenses.TEMPLATES[k] for k in WHOLE]
    commented = ["// " + b.rstrip().replace("\n", "\n// ") + code for b in bodies]
    disclaimers = ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS", "THE SOFTWARE IS PROVIDED"]
    assert all(any(d in " ".join(licenses.TEMPLATES[k].split()) for d in disclaimers) for k in WHOLE if k.startswith(("BSD", "MIT", "ISC")))
    got = licences_of(spark, bodies + [f"Copyright 2020 A. Person\n\n{b}\n{code}" for b in bodies] + commented)
    for i, best in got.items():
        # 1.0 as far as the code is not part of the best unit
        assert max(dice for name, dice in best if name == WHOLE[i % len(WHOLE)]) >= 0.9, (i, best)


# --- ids with several texts --------------------------------------------------------------------------
def changed(text, n):
    return " ".join(["changed"] * n + text.split()[n:])


def test_near_duplicate_stage_tells_texts_of_one_id_apart(spark):
    a, b, c = (text_of(i) for i in (21, 22, 23))
    rows = [(1, a), (5, b), (5, changed(a, 3)), (7, c), (7, changed(c, 3)), (8, text_of(24)), (8, text_of(24)), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()]
    assert len(got) == 6 and {(1, a), (5, b), (8, text_of(24))} <= set(got) and got.count((None, a)) == 2
    assert sum(i == 7 for i, _ in got) == 1 and sum(i == 8 for i, _ in got) == 1


def test_near_duplicates_link_an_id_by_any_of_its_texts(spark):
    base = [text_of(i) for i in range(40, 52)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + j, t) for i, t in enumerate(base) for j in (i // 2, ) for t in (changed(t, 2),)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # ids 100 to 105 have two texts each, and join the originals of both
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i // 2 * 2) for i in range(12)} | {(100 + j, 2 * j) for j in range(6)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == 24
