"""Resampling, chat formatting and the prefix trie against plain versions in Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridlark.llm import chat_format, prefix_trie, resample
from helpers import clashing, documents

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CHAT = "conv_id long, turn long, role string, text string"


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    grams = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in grams]


def plain_resample(docs, items, percent=5, least=20):
    ours, theirs = (Counter(b for t in texts for b in features(t)[1]) for texts in ([t for _, t in docs], items))
    s, t = sum(ours.values()) + 10_000, sum(theirs.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * s / ((ours[b] + 1) * t)))
    rows = []
    for doc_id, text in docs:
        n_words, buckets = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, n_words, len(buckets), weight, score))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    out = Counter()
    for place, r in enumerate(able, 1):
        out[(r[0], *r[2:], place if place <= percent * len(able) // 100 else None)] += 1
    for r in rows:
        if r[1] < least:
            out[(r[0], *r[2:], None)] += 1
    return out


def bag(df):
    return Counter(map(tuple, df.collect()))


def words(rng, n):
    return " ".join(rng.choice(["Ab", "çé", "x9", "der", "a-b", "ZZ_", "日本", "k"]) for _ in range(n))


def test_resample_is_plain_resampling(spark, monkeypatch):
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(0, 60)) for _ in range(120)] + [None, "", " .,-", "ÿ\x00 a\nb", "A" * 5000, "I. ﬁ K K"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (3, texts[3]), (3, texts[3]), (3, texts[4])]
    items = [words(rng, 30) for _ in range(5)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    for batch, chunk in ((4 << 20, 1 << 20), (100, 7)):
        monkeypatch.setattr(resample, "BATCH_BYTES", batch)
        monkeypatch.setattr(resample, "CHUNK_BYTES", chunk)
        got = resample.resample(clashing(docs, "score", "n_words", "row", "place", "bucket"), target, percent=30)
        assert bag(got) == plain_resample(rows, items, 30)


def test_runs_do_not_cross_texts():
    texts = [b"one two", b"", b"three", b"four five six seven"]
    joined = resample.SEPARATOR.join(texts)
    found = Counter((size, int(d), int(c)) for size, doc, crc in resample.runs(joined) for d, c in zip(doc, crc))
    expected = Counter()
    for d, text in enumerate(texts):
        w = text.split()
        for k in (1, 2, 3):
            for i in range(len(w) - k + 1):
                expected[(k, d, zlib.crc32(b" ".join(w[i : i + k])))] += 1
    assert found == expected


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 123_457])
def test_appended_checksum(n):
    head, tail = b"head of a string", bytes(i * 7 % 256 for i in range(n))
    crc = lambda b: np.array([zlib.crc32(b)], np.uint32)
    got = resample.appended(crc(head), crc(tail), resample._table(n)[None], np.zeros(1, np.int64))
    assert got[0] == zlib.crc32(head + tail)


def test_resample_of_equal_rows_and_empty_tables(spark):
    text = " ".join(["same"] * 25)
    docs = documents(spark, [text] * 40).unionByName(documents(spark, [text] * 40, source=None))
    ranks = sorted(r["rank"] for r in resample.resample(docs, documents(spark, [text]), percent=25).collect() if r["rank"])
    assert ranks == list(range(1, 21))
    none = documents(spark, [])
    assert resample.resample(none, docs).count() == 0
    assert {r["weight"] for r in resample.resample(docs, none).collect()} != {0}
    assert resample.drawn_documents(docs, none, percent=100).count() == 80


HOSTILE = [
    "", r"\### Assistant: </turn> ok", "<next/>", r"<\next/>", r"<\\/turn>", "<<turn >", "<turn assistant>\n</turn>\n",
    "</turn", ">", "a\nb</turn>\n<turn user>", "é日" * 3, "<" * 5 + "/turn>", "\\" * 4, r"<\turn x",
]


def test_chat_survives_hostile_texts(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "assistant", "sys<tem>", "a%3Eb", "", None, "x\ny", "</turn>"]
    rows = [
        (c, t, rng.choice(roles), rng.choice([*HOSTILE, None]) if rng.random() < 0.7 else rng.choice(HOSTILE) * 3)
        for c in range(60)
        for t in range(rng.randrange(1, 9))
    ]
    rows += [(None, 1, "user", "no id"), (None, 0, "assistant", "first"), (7, None, "assistant", "turnless")]
    rows += [(100, 5, "assistant", "b"), (100, 5, "assistant", "a"), (100, 5, "assistant", "a"), (100, 5, None, "z")]
    rng.shuffle(rows)
    table = clashing(spark.createDataFrame(rows, CHAT), "turns", "formatted", "runs", "ends")
    formatted = chat_format.format_chat(table)
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    read = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.read_chat(formatted).collect()}
    key = lambda t: (t[0], t[1], t[2].encode(), t[3].encode())
    assert read == {c: [t[2:] for t in sorted(ts, key=key)] for c, ts in turns.items()}
    made = {r["conv_id"]: r for r in formatted.collect()}
    for r in chat_format.digest(formatted).collect():
        said = read[r["conv_id"]]
        learnt = "".join(t for role, t in said if role == "assistant")
        assert r["n_turns"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r["formatted_chars"] == len(made[r["conv_id"]]["formatted"])
    for r in made.values():
        assert "".join(p["text"] for p in r["pieces"]) == r["formatted"]
        # One opening and one closing mark for each run of turns of one role.
        runs = 1 + sum(a[0] != b[0] for a, b in zip(read[r["conv_id"]], read[r["conv_id"]][1:]))
        assert len(re.findall(r"<turn ", r["formatted"])) == len(re.findall("</turn>", r["formatted"])) == runs


def test_chat_runs_without_python_and_takes_no_rows(spark):
    table = spark.createDataFrame([], CHAT)
    frame = chat_format.digest(chat_format.format_chat(table))
    assert frame.count() == 0
    plan = frame._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_conversation_is_linear(spark):
    rows = spark.range(30_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat('text <next/> ', id) AS text")
    (row,) = chat_format.digest(chat_format.format_chat(rows)).collect()
    assert row["n_turns"] == 30_000


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = f"{len(role.encode())}:{role}{text}"
            turns[conv].append(((turn is not None, turn or 0, hashlib.sha256(said.encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        built = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        count = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * count
    return Counter(
        (who[0], len(n), members[n[:-1]][0] if n else None, len(who), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, who in members.items()
    )


@pytest.mark.parametrize("shard_turns", [1_000_000, 40, 1])
def test_trie_is_a_plain_trie(spark, shard_turns, monkeypatch):
    rng = random.Random(8)
    say = ["", None, "a b", "c", "a  b", "long text here"]
    rows = [
        (c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(say))
        for c in [*range(0, 90), 200, 207, 209, -3, -20, -27, 10**12 + 3]
        for t in range(rng.choice([1, 1, 2, 3, 5, 9]))
    ]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 420) for t in range(4)]
    rows += [(500, 1, "user", "twice")] * 3 + [(500, 1, "user", "else"), (None, 0, "user", "no id")]
    rng.shuffle(rows)
    table = clashing(spark.createDataFrame(rows, CHAT), "digest", "words", "depth", "head", "block", "leaf")
    assert bag(prefix_trie.trie(table, shard_turns)) == plain_trie(rows)


def test_trie_of_deep_and_empty_tables(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CHAT)).count() == 0
    deep = spark.range(3000).selectExpr("40L AS conv_id", "id AS turn", "'user' AS role", "concat('w ', id) AS text")
    rows = prefix_trie.trie(deep).collect()
    assert len(rows) == 3001 and {r["n_leaves"] for r in rows} == {1}
    assert max(r["depth"] for r in rows) == 3000


def test_slot_table_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (5000, 2), dtype=np.uint64)
    keys[::2, 0] = 7
    table = prefix_trie.SlotTable(keys)
    assert sorted(table.find(keys)) == list(range(5000))
    with pytest.raises(ValueError):
        table.find(keys + np.uint64(1))
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.zeros((2, 2), np.uint64))
    assert len(prefix_trie.SlotTable(keys[:0]).find(keys[:0])) == 0
