import random
from collections import Counter

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from cairn.llm import fingerprints, history, queries


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randint(0, 2), rng.randrange(len(words))
        if kind == 0:
            words[at] = rng.choice("pqrstuvw")
        elif kind == 1:
            words.insert(at, rng.choice("pqrstuvw"))
        elif len(words) > 1:
            del words[at]
    return words


def test_near_is_the_edit_distance():
    rng = random.Random(4)
    for _ in range(3000):
        a = rng.choices("abcdefgh", k=rng.randint(0, 30))
        b = edited(rng, a or ["x"], rng.randint(0, 9))
        assert fingerprints.near(a, b) == (edit_distance(a, b) <= max(len(a), len(b)) // 5) == fingerprints.near(b, a), (a, b)
    long = [str(i * i % 9973) for i in range(30_000)]
    assert fingerprints.near(long, edited(rng, long, 5900)) and not fingerprints.near(long, [w + "x" if i % 4 == 0 else w for i, w in enumerate(long)])


def shown(order, texts):
    """The keys of each text."""
    data = fingerprints.Texts.of(texts)
    text, keys = order.chosen(data, data.words(), data.prints())
    out = [set() for _ in texts]
    for t, k in zip(text.tolist(), keys.tolist()):
        out[t].add(k)
    return out, list(zip(*(m.tolist() for m in data.maps())))


def orders(texts):
    """Orders by true counts, by none, and two by which much or all is common."""
    for common, bits in ((64, 12), (3, 8), (1, 4)):
        at, n = fingerprints.counted(fingerprints.Texts.of(texts), bits)
        tables = np.zeros(1 << bits, np.int64), np.zeros(1 << fingerprints.WORD_BITS, np.int64)
        tables[0][at[at >= 0]], tables[1][-1 - at[at < 0]] = n[at >= 0], n[at < 0]
        order = fingerprints.Order.of(*tables)
        order.common = int(fingerprints._quantised(np.array([common]))[0])
        yield fingerprints.Order.from_bytes(order.to_bytes())
    yield fingerprints.Order.of(np.zeros(4, np.int64), np.zeros(1 << fingerprints.WORD_BITS, np.int64))


def test_near_texts_always_share_a_key_and_pass_the_maps():
    rng = random.Random(6)
    texts = []
    for _ in range(3000):
        n = rng.randint(4, 60)
        a = rng.choices("abcdefghijklmno", k=n) if rng.random() < 0.5 else [str(i) for i in range(n)]
        texts += [a, edited(rng, a, rng.randint(1, max(1, n // 5)))]
    for n in range(5, 120):
        a = [f"w{i}" for i in range(n)]
        texts += [a, [f"x{i}" if i % 5 == 2 and i // 5 < n // 5 else w for i, w in enumerate(a)]]
    for order in orders(texts):
        keys, maps = shown(order, texts)
        pairs = 0
        for i in range(0, len(texts), 2):
            a, b = texts[i], texts[i + 1]
            if a != b and fingerprints.near(a, b):
                pairs += 1
                assert keys[i] & keys[i + 1], (a, b)
                bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(maps[i], maps[i + 1]))
                assert bits <= 2 * (max(len(a), len(b)) // 5)
        assert pairs > 2000


def test_a_common_phrase_does_not_bring_texts_together():
    rng = random.Random(7)
    phrase = [f"b{i}" for i in range(20)]
    texts = [phrase + [f"w{rng.randrange(10**9)}" for _ in range(30)] for _ in range(2000)]
    order = next(iter(orders(texts)))
    keys, _ = shown(order, texts)
    assert max(Counter(k for ks in keys for k in ks).values()) < 50
    assert max(map(len, keys)) < 400


def test_words():
    assert fingerprints.words_of("Café &amp;amp; CAFÉ, https://x.test/a?b z​z! ｆｕｌｌ") == ["café", "café", "zz", "full"]
    assert fingerprints.post_text('{"data":[{"text":"a"}]}') is None and fingerprints.post_text('"{\\"data\\":{\\"text\\":\\"a\\"}}"') == "a" and fingerprints.post_text(None) is None


def brute(first, batch):
    """One after another, held against every accepted record."""
    accepted, out = list(first), []
    for i, dig, words in sorted(batch, key=lambda r: r[0]):
        hits = [j for j, d, w in accepted if (dig and d == dig) or (words and w and fingerprints.near(words, w))]
        if hits:
            out.append((min(hits), i))
        else:
            accepted.append((i, dig, words))
    return sorted(out)


def record(i, dig, words):
    return (i, dig, None if words is None else '{"data":{"text":"%s"}}' % " ".join(words))


def run(spark, first, *batches):
    frame = lambda rows: spark.createDataFrame([(*record(*r), "x") for r in rows], "id bigint, dig string, content string, norm string")
    store = history.History(spark, history.shared_folder(spark, "test"))
    store.start(frame(first))
    out = []
    for b in batches:
        store = history.History(spark, store.folder)  # as a later process finds it
        out += [tuple(r) for r in store.check(frame(b)).collect()]
    return sorted(out)


def test_whole_tables_against_brute_force(spark, folder):
    from cairn.functions.jsontext import storable

    clean = lambda d: None if d is None or len(c := d.strip().upper().removeprefix("SHA1:")) != 32 else storable(c)
    s, d = pd.read_parquet(f"{folder}/snapshots.parquet"), pd.read_parquet(f"{folder}/download_results.parquet")
    d = d[d.outcome == "success"]
    words = lambda c: fingerprints.words_of(t) if (t := fingerprints.post_text(c)) else None
    first = [(i, clean(g), words(c)) for i, g, c in zip(s.snap_id, s.digest, s.content)]
    batch = [(i, clean(e if a is None else a), words(c)) for i, a, e, c in zip(d.result_id, d.actual_digest, d.expected_digest, d.content)]
    got = sorted(tuple(r) for r in queries.p6_found(spark, folder).collect())
    assert got == brute(first, batch) and len(got) > 20


def test_chains_in_and_across_batches(spark):
    rng = random.Random(8)
    base = [[f"w{i}-{j}".replace("-", "x") for j in range(20)] for i in range(4)]
    rows, i = [], 0
    for _ in range(60):
        words = edited(rng, rng.choice(base), rng.randint(0, 6))
        base.append(words)  # chains: near to a case isn't near to the accepted
        i += 1
        rows.append((i, rng.choice([None, "A", "B", "C", f"D{i}"]), words if rng.random() < 0.9 else None))
    assert run(spark, rows[:10], rows[10:40], rows[40:]) == brute(rows[:10], rows[10:])


def test_odd_records(spark):
    first = [(1, "A", None), (2, None, None), (3, "A", ["one"] * 3)]
    batch = [(10, None, None), (11, None, None), (12, "A", None), (13, None, ["one"] * 3), (14, None, ["..."]), (15, None, ["..."]), (16, "Z", ["a"] * 5), (17, None, ["a"] * 4), (18, "Z", None), (19, None, ["a"])]
    assert run(spark, first, batch) == [(1, 12), (3, 13), (16, 17), (16, 18)]
    assert run(spark, first, []) == [] and run(spark, [], batch[:3]) == [] and run(spark, [], [], batch) == [(16, 17), (16, 18)]


def test_a_third_of_all_rows_in_one_class(spark):
    batch = [(i, "HOT" if i % 3 == 0 else f"D{i}", ["same", "text", "again", "and", "again"] if i % 3 == 1 else None) for i in range(10, 3000)]
    got = run(spark, [(1, "x", None)], batch)
    assert got == sorted([(12, i) for i, *_ in batch if i % 3 == 0 and i > 12] + [(10, i) for i, *_ in batch if i % 3 == 1 and i > 10])


def test_ids_in_any_order(spark):
    rows = [(100, "A", ["x"] * 6), (300, None, ["y"] * 6)]
    assert run(spark, rows, [(50, "A", None), (200, "A", None), (250, None, ["y"] * 5 + ["z"]), (400, None, ["y"] * 6)]) == [(50, 200), (250, 400)]
    assert run(spark, rows, [(200, "A", None), (50, "A", None)], [(60, "A", None), (40, "A", None)]) == [(40, 60), (50, 200)]


def test_hot_batches_are_split_and_runs_merged(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(20)]
    rows = [(i, rng.choice([None, f"D{i % 40}"]), edited(rng, base, rng.randint(0, 6)) if i % 2 else [f"v{rng.randrange(50)}" for _ in range(12)]) for i in range(1, 81)]
    monkeypatch.setattr(history, "MOST_SHARING", 12)
    monkeypatch.setattr(history, "FANOUT", 2)
    monkeypatch.setattr(history, "BUCKET_ROWS", 64)
    monkeypatch.setattr(history, "PART_KEYS", 32)
    monkeypatch.setattr(history, "PARTS_TOGETHER", 2)
    assert run(spark, rows[:20], rows[20:]) == brute(rows[:20], rows[20:])


def test_a_step_reads_of_the_store_what_its_batch_needs(spark, monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(history, "BUCKET_ROWS", 500)
    monkeypatch.setattr(history, "PART_KEYS", 64)
    monkeypatch.setattr(history, "PARTS_TOGETHER", 8)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(24)]
    rows = [(i, f"D{i}", text()) for i in range(1500)]
    frame = lambda rows: spark.createDataFrame([record(*r) for r in rows], "id bigint, dig string, content string")
    store = history.History(spark, history.shared_folder(spark, "test"))
    store.start(frame(rows))
    opened, read = [], store.read

    def counting(table, runs=None, buckets=None):
        df = read(table, runs, buckets)
        if runs is None or table == "filters":
            opened.append((table, len(df.inputFiles()) and df.select("run", F.input_file_name().alias("f")).distinct().count()))
        return df

    monkeypatch.setattr(store, "read", counting)
    assert sorted(tuple(r) for r in store.check(frame([(5000, "D7", None), (5001, None, rows[9][2][:-2] + ["new"]), (5002, "Z", text())])).collect()) == [(7, 5000), (9, 5001)]
    all_files = {t: read(t, store.runs[:1]).select(F.input_file_name()).distinct().count() for t in ("postings", "texts", "keys", "filters")}
    found = {t: sum(n for u, n in opened if u == t) for t in all_files}
    assert all_files["postings"] > 50 and all_files["filters"] > 20 and found["keys"] <= 4 and found["texts"] <= 3 and found["postings"] <= 40 and found["filters"] <= all_files["filters"], (found, all_files)


def test_filters_keep_their_rate_as_the_store_grows(spark):
    rng = random.Random(11)
    frame = lambda a, b: spark.createDataFrame([record(i, f"D{i}", [f"w{rng.randrange(10**6)}" for _ in range(12)]) for i in range(a, b)], "id bigint, dig string, content string")
    store = history.History(spark, history.shared_folder(spark, "test"))
    store.start(frame(0, 50))
    store.check(frame(50, 5000))
    asked = spark.range(20_000).crossJoin(spark.createDataFrame([(r.name,) for r in store.runs], "run string")).selectExpr("run", "xxhash64(id, 99) print")
    assert store.positives(asked).count() < 0.01 * 20_000 * len(store.runs)
