"""The manifest, conversation repair and substring dedup against brute force, on odd rows and on
sizes that take several blocks, chunks and flushes."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from strata.llm import merkle, queries, repair, substrings

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(300)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def text_of(seed, n=120, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


# --- manifest ------------------------------------------------------------------------------------------
def brute_tree(digests):
    """Levels of a tree, and each leaf's siblings."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    paths = [[levels[k][(i >> k) ^ 1] for k in range(len(levels) - 1) if (i >> k) ^ 1 < len(levels[k])] for i in range(len(digests))]
    return levels[-1][0], paths


def brute_fold(digest, i, total, path):
    path = list(path)
    while total > 1:
        if i ^ 1 < total:
            s = path.pop(0)
            digest = sha(s + digest if i & 1 else digest + s)
        else:
            digest = sha(digest)
        i, total = i >> 1, (total + 1) >> 1
    return digest


def brute_manifest(rows):
    def leaf(r, more=0):
        out = []
        for name in merkle.FIELDS:
            v = r[name]
            v = v + more if name == "n_chars" and v is not None else v
            out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
        return sha("".join(out))

    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    subs, parts = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, paths = brute_tree([leaf(r) for r in own])
        subs.append(root), parts.append((own, paths))
    top, tops = brute_tree(subs) if subs else (None, [])
    out = []
    for g, (own, paths) in enumerate(parts):
        for i, r in enumerate(own):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            sub = brute_fold(leaf(r, int(bad)), i, len(own), paths[i])
            folded = brute_fold(sub, g, len(subs), tops[g])
            out.append((r["doc_id"], leaf(r), subs[g], top, sha("".join(paths[i] + tops[g])), folded, folded == top))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def manifest_rows(n):
    r = random.Random(n)
    langs = ["en", "en", "en", "fr", None, "é", "zz"]
    rows = [(i, text_of(i, 5), r.choice(langs), f"s{i % 3}", 10 * i) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "x", "en", "s", 1), (5, "again", "en", "s", 1), (5, "again", "en", "s", 1),
                   (77, "lone", "only", None, 2), (49, "", "", "", 0), (9, "é" * 100_000, "fr", "s", None)]


def run_manifest(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("own") for c in ("g", "at", "digest", "path", "root", "salt", "total")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op11_merkle_manifest(spark, str(tmp_path)), [r.asDict() for r in df.collect()]


def test_manifest_equals_brute_force(spark, tmp_path):
    found, rows = run_manifest(spark, manifest_rows(90), tmp_path)
    assert order(found.collect()) == order(brute_manifest(rows))
    assert not found.where("NOT verified").isEmpty()


def test_manifest_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 3)
    found, rows = run_manifest(spark, manifest_rows(150), tmp_path)
    assert order(found.collect()) == order(brute_manifest(rows))


def test_manifest_of_an_empty_table(spark, tmp_path):
    found, _ = run_manifest(spark, [], tmp_path)
    assert found.collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_witnesses_of_a_stream(n):
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    block = merkle.Witnesses()
    for d in digests:
        block.append(d)
    assert len(block.open) == bin(n).count("1")  # a frontier of open subtrees
    root, paths = brute_tree([d.hex() for d in digests])
    assert block.close(None).hex() == root and [[s.hex() for s in p] for p in block.paths] == paths


# --- repair ----------------------------------------------------------------------------------------------
def brute_repair(rows):
    """Columns of one conversation from its damaged rows (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, q, inserts):
        """(cost, audit, repaired rows) to end well."""
        out = [(0, "", ())] if i == len(rows) and q in ("", "a") else []
        if inserts < 3:
            c, a, f = best(i, after[q], inserts + 1)
            out.append((c + 5, "I" + a, (full[after[q]] + ":",) + f))
        if i < len(rows):
            c, a, f = best(i + 1, q, 0)
            out.append((c + 2, "D" + a, f))
            if faults[i] in ("", "truncated"):
                _, role, text = rows[i]
                more = 5 * (faults[i] == "truncated")
                k = role[:1]
                if k and k in "sua" and (k == after[q] or (k == "s" and q == "")):
                    c, a, f = best(i + 1, k, 0)
                    out.append((c + more, "K" + a, (f"{role}:{text}",) + f))
                c, a, f = best(i + 1, after[q], 0)
                out.append((c + more + 1, "R" + a, (f"{full[after[q]]}:{text}",) + f))
        return min(out, default=(10 ** 6, "", ()))

    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, fixed = best(0, "", 0)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(fixed)))


def brute_conversations(rows):
    out, conv = {}, {}
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        conv.setdefault(c, [])
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(x): None for x in ".!?"}) if fault == 2 else text
        conv[c] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for c, own in conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out[c] = brute_repair(own)
    return out


def conversation_rows(seed, convs, most):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "no", " ", "Well! ", "Why?\n", "é.", None, "x" * 50_000 + ".", "a b.\t", " "]
    rows = []
    for c in range(convs):
        for turn in range(r.randrange(most)):
            rows.append((c, turn + r.randrange(2), r.choice(roles[:5] if c % 2 else roles), r.choice(texts[:4] if c % 3 else texts) if r.random() < .5 else f"t{turn}."))
    return rows + [(None, 1, "user", "hi."), (None, 1, "user", "hi."), (None, None, None, None), (None, None, "assistant", "ok."), (500, None, "user", "a.")]


def run_repair(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumns({c: F.lit("own") for c in ("at", "fault", "edits", "chunk", "salt", "end")}).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op12_conversation_repair(spark, str(tmp_path))
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def test_repair_equals_brute_force(spark, tmp_path):
    rows = conversation_rows(1, 60, 12)
    assert run_repair(spark, rows, tmp_path) == brute_conversations(rows)


@pytest.mark.parametrize("chunk", [1, 3])
def test_repair_over_many_chunks(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = conversation_rows(chunk, 25, 25)
    assert run_repair(spark, rows, tmp_path) == brute_conversations(rows)


def test_repair_of_an_empty_table(spark, tmp_path):
    assert run_repair(spark, conversation_rows(1, 0, 1)[:0], tmp_path) == {}


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    steps = repair.Steps()
    r = random.Random(5)
    codes = "".join(r.choice("ADEGHFCK") for _ in range(200))
    ends = [repair.level(repair.GOAL), (0, 5, 5, 0), (3, 0, 1, 2)]
    begin = repair.backward(codes, ends[0], steps)
    for end in ends:
        assert repair.backward(codes, end, steps, (ends[0], begin)) == repair.backward(codes, end, steps)


def test_passes_end(spark):
    r = random.Random(6)
    chunks = [(1, k, "".join(r.choice("ADEGHFCK") for _ in range(6)), k == 39) for k in range(40)]
    df = spark.createDataFrame(chunks, "conv_id long, chunk long, codes string, last boolean")
    state, passes = repair.converged(df)
    ends = {x.chunk: tuple(x.end) for x in state.collect()}
    end, steps = repair.level(repair.GOAL), repair.Steps()
    for k in reversed(range(40)):
        assert ends[k] == end
        end = repair.backward(chunks[k][2], end, steps)
    assert 0 < passes < 40


# --- substrings --------------------------------------------------------------------------------------------
def brute_substrings(rows, window=substrings.WINDOW):
    """(doc_id, n_words, n_removed, digest) of each row."""
    docs = {}
    for doc_id, text in rows:
        ws = tuple((text or "").encode().split())
        docs[(doc_id is not None, doc_id or 0, hashlib.sha256(b" ".join(ws)).digest())] = ws
    seen, out = set(), {}
    for key in sorted(docs):
        ws, gone = docs[key], set()
        for s in range(len(ws) - window + 1):
            g = ws[s:s + window]
            if g in seen:
                gone.update(range(s, s + window))
            seen.add(g)
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out[key] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return [(d, *out[(d is not None, d or 0, hashlib.sha256(b" ".join((t or "").encode().split())).digest())]) for d, t in rows]


def passage_rows(seed, n, words=WORDS):
    r = random.Random(seed)
    passages = [text_of(f"p{i}", r.choice([19, 20, 21, 30, 60, 150]), words) for i in range(12)]
    rows = []
    for i in range(n):
        parts = [text_of(f"{seed}-{i}-{j}", r.randrange(0, 80), words) if r.random() < .6 else r.choice(passages) for j in range(r.randrange(5))]
        rows.append((r.randrange(10 ** 6), " \n".join(parts)))
    long = text_of("long", 3000, words)
    run = "la " * 70
    return rows + [(1, long), (2, long.replace("w7 ", "w8 ")), (3, long[500:9000]), (4, long), (None, long[:4000]), (None, None), (5, ""), (6, run),
                   (7, "x " + run + "y"), (7, run[:60]), (8, "one two " * 40), (8, "two " + "one two " * 30), (9, passages[3]), (9, passages[3]),
                   (10, passages[3].replace(" ", "\t")), (11, " \t\n"), (12, "é ü " * 50)]


def run_substrings(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("at", "key", "h", "names", "n_words")})
    return substrings.repeated_words(df)


def test_substrings_equal_brute_force(spark):
    rows = passage_rows(1, 150)
    assert order(run_substrings(spark, rows).collect()) == order(brute_substrings(rows))


def test_substrings_of_few_words_in_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", 200)
    monkeypatch.setattr(substrings, "IDS", 50)
    monkeypatch.setattr(substrings, "CUT", 4)
    for words in (["a", "b"], ["a"], WORDS[:12]):
        rows = passage_rows(2, 60, words)
        assert order(run_substrings(spark, rows).collect()) == order(brute_substrings(rows))


def test_substrings_of_an_empty_table(spark):
    assert run_substrings(spark, passage_rows(1, 0)[:0]).collect() == []


def test_substrings_do_not_depend_on_partitions(spark):
    rows = passage_rows(3, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (substrings.repeated_words(df.repartition(k)).collect() for k in (1, 13))
    assert order(one) == order(many)


def test_equal_windows_elect_equal_symbols():
    import numpy as np
    passage = text_of("elect", 60).encode().split()
    names = []
    for seed in range(30):
        r = random.Random(seed)
        words = text_of(seed, r.randrange(0, 40)).encode().split() + passage + text_of(-seed, r.randrange(0, 40)).encode().split()
        p = substrings._parse([words], substrings.Ids())
        start = len(words) and words.index(passage[0]) if words[:60] == passage else next(
            i for i in range(len(words)) if words[i:i + 60] == passage)
        best = p.elected()[0][start:start + 60 - substrings.WINDOW + 1]
        assert (best >= 0).all()
        names.append(tuple(p.stretch_names(best)) + tuple(p.start[best] - start))
        assert np.all(p.low[best] >= start) and np.all(p.high[best] <= start + 60)
    assert len(set(names)) == 1


def test_queries_match_brute_force_on_the_given_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert order(queries.op13_substring_dedup(spark, SF).collect()) == order(brute_substrings(docs))
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert order(queries.op11_merkle_manifest(spark, SF).collect()) == order(brute_manifest(rows))
