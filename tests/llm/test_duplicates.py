"""Near-duplicates, repeated spans and lines, and recordings, against plain versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hypso.llm import audio, neardup, queries, repeats

QUERIES = queries.queries()


def labelled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    size = min(5, len(words))
    seen, out = Counter(), []
    for k in range(max(1, len(words) - 4) if words else 0):
        s = tuple(words[k : k + size])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def matched(x, y):
    """Longest common subsequence of two sequences of different items."""
    from bisect import bisect_left

    at = {s: k for k, s in enumerate(x)}
    tails = []
    for p in (at[s] for s in y if s in at):
        k = bisect_left(tails, p)
        tails[k : k + 1] = [p]
    return len(tails)


def classes_of(texts: dict[int, str]) -> dict[int, int]:
    """Plain near-duplicate classes: all pairs that share a shingle."""
    shingles = {d: labelled(t) for d, t in texts.items()}
    where = defaultdict(list)
    for d, own in shingles.items():
        for s in own:
            where[s].append(d)
    shared = Counter()
    for docs in where.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                shared[a, b] += 1
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    first = {}
    for d, t in sorted(texts.items()):
        parent[root(d)] = root(first.setdefault(t, d))
    for (a, b), n in shared.items():
        total = len(shingles[a]) + len(shingles[b])
        if n >= 0.8 * (total - n) and texts[a] != texts[b]:
            m = matched(shingles[a], shingles[b])
            if m >= 0.8 * (total - m) - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    least = {}
    for d in sorted(texts):
        least.setdefault(root(d), d)
    return {d: least[root(d)] for d in texts}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_classes_equal_all_pairs(spark, folder):
    """No link is lost, and none is made up."""
    docs = pd.read_parquet(f"/root/testdata/{folder}/documents.parquet")
    plain = classes_of(dict(zip(docs.doc_id, docs.text.fillna(""), strict=True)))
    found = QUERIES["op1_order_minhash"](spark, f"/root/testdata/{folder}").toPandas()
    own = dict(zip(found.doc_id, found.class_id, strict=True))
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    assert {d: c for d, c in own.items() if texts[d] is not None} == {d: c for d, c in plain.items() if texts[d] is not None}


def test_a_crowd_and_a_chain(spark):
    """A passage that all share makes no class; a chain of edits does."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passage = " ".join(word() for _ in range(60))
    data = [(k, passage + " " + " ".join(word() for _ in range(60))) for k in range(80)]
    chain = [word() for _ in range(200)]
    for k in range(100, 130):
        data.append((k, " ".join(chain)))
        chain[int(rng.integers(0, 200))] = word()
    data += [(200, data[0][1]), (201, data[0][1])]
    found = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    own = {r["_doc"]: r["class_id"] for r in found}
    assert own == classes_of(dict(data))
    assert {own[k] for k in range(100, 130)} == {100} and own[201] == 0 and len(set(own.values())) == 81


def test_pairs_in_a_crowd_are_found(spark):
    """A thousand planted pairs over a passage that makes up 80 % of each text."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    passage = " ".join(word() for _ in range(160))
    data = []
    for k in range(1000):
        own = [word() for _ in range(40)]
        other = list(own)
        for at in (3, 20, 37):
            other[at] = word()
        data += [(2 * k, passage + " " + " ".join(own)), (2 * k + 1, passage + " " + " ".join(other))]
    for a, b in zip(data[::2], data[1::2], strict=True):
        x, y = (labelled(t[1]) for t in (a, b))
        m = matched(x, y)
        assert m >= 0.8 * (len(x) + len(y) - m)
    found = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r["_doc"]: r["class_id"] for r in found} == {k: k // 2 * 2 for k in range(2000)}


def test_large_clusters_hold_their_pairs(spark):
    """A cloud of 1500 edited copies of one text, of which many pairs are similar and more are not: nine in
    ten similar pairs at least are in one class, and no class has texts that no links join."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    base, data = [word() for _ in range(120)], []
    for k in range(1500):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 5)):
            own[at] = word()
        data.append((k, " ".join(own)))
    plain = classes_of(dict(data))
    found = {r["_doc"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    together = lambda classes: sum(n * (n - 1) // 2 for n in Counter(classes).values())
    both = Counter((plain[k], found[k]) for k in plain)
    assert sum(n * (n - 1) // 2 for n in both.values()) >= 0.9 * together(plain.values())
    assert len({b for _, b in both}) == len(both)


def test_no_similar_pair_of_a_cloud_is_left_out(spark):
    """As above, where some texts are similar to a few others only and to no hub: classes equal those of all pairs."""
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    base, data = [word() for _ in range(120)], []
    for k in range(700):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(2, 6)):
            own[at] = word()
        data.append((k, " ".join(own)))
    found = {r["_doc"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == classes_of(dict(data))


def test_order_counts(spark):
    """The same shingles in another order are not similar."""
    words = [f"w{k}" for k in range(300)]
    a = " ".join(words)
    b = " ".join(words[150:] + words[:150])
    found = neardup.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a + " end")], "doc_id long, text string")).collect()
    assert {r["_doc"]: r["class_id"] for r in found} == {1: 1, 2: 2, 3: 1}


def test_one_of_each_keeps_a_row_of_every_class(spark, mixed_dir, rows):
    docs = spark.read.parquet(f"{mixed_dir}/documents.parquet")
    kept = neardup.one_of_each(docs).collect()
    found = neardup.near_duplicates(docs).where("_t IS NOT NULL").select("class_id").distinct().count()
    assert len(kept) == found + sum(r["text"] is None for r in rows)


def test_one_of_near_copies_without_doc_ids_of_their_own_stays(spark):
    words = lambda c: " ".join(f"{c}{k}" for k in range(200))
    data = [(None, words("a")), (None, words("a") + " end"), (None, words("b")), (5, words("c")), (5, words("c") + " end"), (5, words("d"))]
    kept = [r["text"] for r in neardup.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    assert sorted(t[0] for t in kept) == ["a", "b", "c", "d"]


def test_one_of_each_class_of_a_cloud_stays(spark):
    """The pipeline's stage keeps one row of each class of all pairs, also of those that no hub joins."""
    rng = np.random.default_rng(15)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    base, data = [word() for _ in range(120)], []
    for k in range(400):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(2, 6)):
            own[at] = word()
        data.append((k, " ".join(own)))
    kept = neardup.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(classes_of(dict(data)).values()))


def plain_sentences(text):
    """Letter by letter: a sentence ends at blanks after a full stop with its closing marks, and at a line end."""
    units, own, k = [], "", 0
    while k < len(text):
        own += text[k]
        k += 1
        closed = own.rstrip("\"')]|")
        if text[k - 1] == "\n" or (k < len(text) and text[k].isspace() and closed and closed[-1] in ".!?"):
            while k < len(text) and text[k].isspace():
                own += text[k]
                k += 1
            units.append(own)
            own = ""
    return units + [own] if own else units


def plain_spans_of(text):
    """Units and all minimal runs of two sentences and eight words: those that no shorter one fits into
    from their start or to their end."""
    units = plain_sentences(text)
    size = [len(u.split()) for u in units]
    good = lambda a, b: b - a >= 2 and sum(size[a:b]) >= 8
    runs = set()
    for a in range(len(units)):
        b = next((b for b in range(a + 2, len(units) + 1) if good(a, b)), None)
        if b is None:
            break
        runs.add((a, b))
    for b in range(2, len(units) + 1):
        a = next((a for a in range(b - 2, -1, -1) if good(a, b)), None)
        if a is not None:
            runs.add((a, b))
    return units, [(a, b, tuple(w for u in units[a:b] for w in [*u.split(), None])) for a, b in sorted(runs)]


def plain_windows_of(text):
    """Lines, and every window of two lines with a word and every line of eight words: no fingerprints."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    real = [(k, u.strip(" \t\n\x0b\x0c\r")) for k, u in enumerate(units)]
    real = [(k, u) for k, u in real if u]
    runs = [(k, k + 1, (u,)) for k, u in real if len(re.split("[ \t\n\x0b\x0c\r]+", u)) >= 8]
    runs += [(a, b + 1, (u, v)) for (a, u), (b, v) in zip(real, real[1:])]
    return units, sorted(runs)


def plain_repeats(rows, cut):
    """What a plain loop removes: (doc, text) to what is left."""
    first = {}
    key = lambda r: ((1 << 63) - 1, r["text"]) if r["doc_id"] is None else (r["doc_id"], "")
    known = [r for r in rows if r["text"]]
    for r in known:
        for run in cut(r["text"])[1]:
            first[run[2]] = min(first.get(run[2], key(r)), key(r))
    out = Counter()
    for r in rows:
        units, runs = cut(r["text"] or "")
        seen, gone = set(), set()
        for run in runs:
            if run[2] in seen or first[run[2]] < key(r):
                gone.update(range(run[0], run[1]))
            seen.add(run[2])
        text = r["text"] if r["text"] is None else "".join(u for k, u in enumerate(units) if k not in gone)
        out[r["doc_id"], text, len(gone)] += 1
    return out


@pytest.mark.parametrize(("name", "cut"), [("op4_sentence_spans", plain_spans_of), ("op7_line_winnowing", plain_windows_of)])
@pytest.mark.parametrize("folder", ["mixed", "sf0.01"])
def test_repeats_equal_a_plain_loop(spark, mixed_dir, rows, name, cut, folder):
    if folder != "mixed":
        mixed_dir = f"/root/testdata/{folder}"
        rows = spark.read.parquet(f"{mixed_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES[name](spark, mixed_dir).collect()
    assert Counter((r["doc_id"], r["text"], r["n_removed"]) for r in found) == plain_repeats(rows, cut)


@pytest.mark.parametrize("count", [1, 2, 3, 5])
def test_repeats_of_random_lines(spark, count):
    """Few different lines, so that runs overlap, touch and repeat in every way; windows of any size."""
    rng = np.random.default_rng(count)
    kinds = ["a", "b", "c c", "", "  ", "one two three four five six seven eight", "nine words are in this line as it is"]
    data = [(k, "\n".join(rng.choice(kinds, rng.integers(0, 14)))) for k in range(120)]
    first, left = {}, {}

    def windows(text):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        real = [(k, u.strip()) for k, u in enumerate(units) if u.strip()]
        runs = [(real[k][0], real[k + count - 1][0] + 1, tuple(u for _, u in real[k : k + count])) for k in range(len(real) - count + 1)]
        return units, set(runs) | {(k, k + 1, (u,)) for k, u in real if len(u.split()) >= 8}

    for d, text in data:
        units, runs = windows(text)
        gone, own = set(), set()
        for a, b, h in sorted(runs):
            if h in own or h in first:
                gone.update(range(a, b))
            own.add(h)
        first |= dict.fromkeys(own, d)
        left[d] = "".join(u for k, u in enumerate(units) if k not in gone), len(gone)
    found = repeats.without_repeated_lines(spark.createDataFrame(data, "doc_id long, text string"), count=count).collect()
    assert {r["doc_id"]: (r["clean_text"], r["n_removed"]) for r in found} == left


def test_fingerprints_cost_less_and_lose_nothing():
    """Windows that share a line mostly select it together; every window is behind some fingerprint."""
    rng = np.random.default_rng(2)
    text = "\n".join("".join(rng.choice(list("abcdef"), 6)) for _ in range(4000))
    for count in (2, 4, 8):
        prints = repeats.line_prints(text, count)[1]
        windows = [r for _, runs in prints for r in runs]
        assert sorted((r.first, r.end) for r in windows) == [(k, k + count) for k in range(4000 - count + 1)]
        assert len(prints) < 1.1 * 4000 * 2 / (count + 1)
        again = repeats.line_prints("another first line\n" + text, count)[1]
        assert {(p, r.hash) for p, runs in prints for r in runs} <= {(p, r.hash) for p, runs in again for r in runs}


def test_units_make_up_the_text(rows):
    for r in rows:
        text = r["text"] or ""
        assert "".join(repeats.sentences(text)) == text
        assert "".join(repeats.line_prints(text)[0]) == text


def test_last_sentences_are_covered(spark):
    body = "Ten words are in this first sentence of the text. Then. There. End."
    data = [(1, "Some other beginning of it that nobody shares. " + body), (2, body), (3, None), (None, body), (None, body + " Tail.")]
    left = {(r["doc_id"], r["clean_text"]) for r in repeats.without_repeated_spans(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert left == {(1, data[0][1]), (2, ""), (3, None), (None, ""), (None, "Tail.")}


def test_planted_passages_go_from_the_later_document(spark):
    passage = "This sentence has a number of words that nobody else would write. " * 1 + "So has the next one which goes on for a while in the same vein. And a third one closes the passage with yet more words."
    lines = "\n".join(f"line {k} of a block that repeats" for k in range(6))
    data = [(1, f"Alpha begins here.\n{passage}\nAlpha ends."), (2, f"Beta begins elsewhere.\n{passage}\nBeta ends."), (3, f"head\n{lines}\ntail"), (4, f"other head\n{lines}\nother tail"), (5, "A single common line\nalone"), (6, "x\nA single common line\ny")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    left = {r["doc_id"]: r["clean_text"] for r in repeats.without_repeated_spans(docs).collect()}
    assert left[1] == data[0][1] and passage not in left[2] and "Beta begins" in left[2] and "Beta ends" in left[2]
    left = {r["doc_id"]: r["clean_text"] for r in repeats.without_repeated_lines(docs).collect()}
    assert left[3] == data[2][1] and left[4] == "other head\nother tail" and left[5] == data[4][1] and left[6] == data[5][1]


def test_a_long_line_is_a_run_by_itself(spark):
    licence = "This one line of a licence has more than eight words in it."
    data = [(1, f"head\n{licence}\ntail"), (2, f"other\n\n{licence}\n\nend"), (3, licence), (4, f"x\n{licence}\nhead\n{licence}\ntail"), (5, "seven words are too few for this\na"), (6, "seven words are too few for this\nb")]
    found = {r["doc_id"]: r for r in repeats.without_repeated_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [found[k]["clean_text"] for k in range(1, 7)] == [data[0][1], "other\n\n\nend", "", "x\n", data[4][1], data[5][1]]
    assert [found[k]["removed"] for k in range(1, 7)] == ["", "2-3", "0-1", "1-5", "", ""]


def tune(seed: int, seconds: float, step: float = 0.125) -> np.ndarray:
    rng = np.random.default_rng(seed)
    t = np.arange(int(8000 * step)) / 8000
    scale = 440 * 2 ** (np.arange(-9, 27) / 12)
    notes = [sum(np.sin(2 * np.pi * f * t + p) for f, p in zip(rng.choice(scale, 2), rng.uniform(0, 6, 2), strict=True)) for _ in range(int(seconds / step))]
    return np.concatenate(notes)


def as_bytes(x: np.ndarray) -> bytes:
    return np.clip(128 + 50 * x, 0, 255).astype(np.uint8).tobytes()


def test_recordings_align(spark):
    rng = np.random.default_rng(9)
    data = []
    for s in range(6):
        x = tune(s, 12)
        data += [(10 * s, as_bytes(x)), (10 * s + 1, as_bytes(x + rng.normal(0, 0.01, len(x)))), (10 * s + 2, as_bytes(x[5120:])), (10 * s + 3, as_bytes(x))]
    data += [(100, None), (101, b""), (102, b"abc"), (103, b"abc")]
    found = audio.recordings(spark.createDataFrame(data, "id long, sound binary"), "id", F.col("sound")).collect()
    own = {r["_doc"]: r["class_id"] for r in found}
    assert own == {k: 10 * (k // 10) if k < 100 else 102 if k == 103 else k for k in own} and len(own) == 28


def test_a_loop_that_starts_later_aligns(spark):
    """All integers of a loop recur, so that none of them says by itself where it belongs."""
    loop, other = tune(1, 2), tune(2, 2)
    data = [(1, as_bytes(np.tile(loop, 8))), (2, as_bytes(np.tile(loop, 8)[5 * 512 :])), (3, as_bytes(np.tile(other, 8))), (4, as_bytes(np.tile(loop[::-1], 8)))]
    found = audio.recordings(spark.createDataFrame(data, "id long, sound binary"), "id", F.col("sound")).collect()
    assert {r["_doc"]: r["class_id"] for r in found} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_crowds_of_recordings_are_joined(spark):
    """Forty pairs of recordings that all begin with the same two seconds, so that all meet in some buckets."""
    rng = np.random.default_rng(4)
    intro, data = tune(77, 2), []
    for k in range(40):
        x = np.concatenate([intro, tune(100 + k, 9)])
        data += [(2 * k, as_bytes(x)), (2 * k + 1, as_bytes(x + rng.normal(0, 0.02, len(x))))]
    found = audio.recordings(spark.createDataFrame(data, "id long, sound binary"), "id", F.col("sound")).collect()
    assert {r["_doc"]: r["class_id"] for r in found} == {k: k // 2 * 2 for k in range(80)}


def test_pairs_of_recordings_in_a_crowd_are_found(spark):
    """Pairs of recordings whose first half all share, so that the partners meet in the crowd's buckets only:
    noise leaves few runs of equal integers in the other half. Classes equal those of all pairs."""
    rng = np.random.default_rng(14)
    intro, sounds = tune(78, 5), {}
    for k in range(40):
        tail = tune(200 + k, 5)
        for j in (0, 1):
            sounds[2 * k + j] = as_bytes(np.concatenate([intro, tail + rng.normal(0, 0.5, len(tail)) * j]))
    codes = {k: audio.fingerprint(x).tobytes() for k, x in sounds.items()}
    plain = {k: k for k in codes}
    for b in codes:
        for a in range(b):
            if plain[a] != plain[b] and audio.same_recording(codes[a], codes[b]):
                x, y = sorted((plain[a], plain[b]))
                plain = {k: x if v == y else v for k, v in plain.items()}
    assert plain == {k: k // 2 * 2 for k in range(80)}
    found = audio.recordings(spark.createDataFrame(list(sounds.items()), "id long, sound binary"), "id", F.col("sound")).collect()
    assert {r["_doc"]: r["class_id"] for r in found} == plain


def plain_histogram(x, y) -> Counter:
    at = defaultdict(list)
    for j, v in enumerate(y.tolist()):
        at[v].append(j)
    return Counter(i - j for i, v in enumerate(x.tolist()) for j in at[v])


def plain_match(x, y, hist) -> bool:
    """At any offset at all: an exact histogram, bits counted one by one."""
    for at, equal in hist.items():
        low, high = max(0, at), min(len(x), len(y) + at)
        if high - low >= 0.8 * max(len(x), len(y)) and equal >= 0.4 * (high - low):
            bits = sum(int(a ^ b).bit_count() for a, b in zip(x[low:high].tolist(), y[low - at : high - at].tolist(), strict=True))
            if bits <= 0.15 * 32 * (high - low):
                return True
    return False


@pytest.mark.parametrize("kinds", [8, 200, 1 << 32])
def test_offset_histogram(kinds):
    """The exact histogram's best offset is among those looked at, at the least share of equal integers,
    with recurring integers and with ones that are all different."""
    rng = np.random.default_rng(0)
    for n in (30, 60, 300, 3000):
        x = rng.integers(0, kinds, n).astype(np.uint32)
        for at in (0, n // 10, -(n // 8)):
            y = np.where(rng.random(n) < 0.45, np.roll(x, -at), rng.integers(0, kinds, n)).astype(np.uint32)
            exact = plain_histogram(x, y)
            assert max(range(1 - n, n), key=lambda k: exact[k]) in audio.offsets(x, y), (n, at)
        assert len(audio.votes(x, y[5:])) == 2 * n - 6
    assert audio.offsets(np.arange(50, dtype=np.uint32), np.arange(7, 50, dtype=np.uint32))[0] == 7


def plain_fingerprint(sound: bytes, tuning) -> list[int]:
    """One integer after the other, sums over the image itself."""
    x = (np.frombuffer(sound, np.uint8).astype(float) - 128) / 128
    image = []
    for low in range(0, len(x) - tuning.frame + 1, tuning.hop):
        part = x[low : low + tuning.frame]
        power = np.abs(np.fft.rfft((part - part.mean()) * np.hanning(tuning.frame))) ** 2
        row = [0.0] * 12
        for k, p in enumerate(power):
            pitch = k * tuning.rate / tuning.frame
            if k >= 17 and pitch <= 4200:
                row[round(12 * np.log2(pitch / 440)) % 12] += p
        image.append(np.array(row) / max(np.linalg.norm(row), 1e-9))
    image = np.array(image).reshape(-1, 12)
    out = []
    for t in range(len(image) - tuning.span + 1):
        code = 0
        for kind, c, high, wide in audio.FILTERS:
            box = image[t : t + wide, c : c + high]
            w, h, third = wide // 2, high // 2, high // 3
            if kind == 0:
                a, b = box[:, 1:].sum() / (high - 1), box[:, :1].sum()
            elif kind == 1:
                a, b = box[:, h : 2 * h].sum(), box[:, :h].sum()
            elif kind == 2:
                a, b = box[w : 2 * w].sum(), box[:w].sum()
            elif kind == 3:
                a = box[:w, h : 2 * h].sum() + box[w : 2 * w, :h].sum()
                b = box[:w, :h].sum() + box[w : 2 * w, h : 2 * h].sum()
            else:
                a, b = 2 * box[:, third : 2 * third].sum(), box[:, :third].sum() + box[:, 2 * third : 3 * third].sum()
            level = np.log((1 + a) / (1 + b))
            code = code * 4 + (0, 1, 3, 2)[sum(level > bound for bound in (-0.12, 0.0, 0.12))]
        out.append(code)
    return out


@pytest.mark.parametrize("tuning", [audio.TEXT, audio.Tuning()])
def test_fingerprints_equal_plain_ones(tuning):
    rng = np.random.default_rng(6)
    sounds = [as_bytes(tune(3, 4)), rng.integers(0, 256, 30_000).astype(np.uint8).tobytes(), " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(1, 9))) for _ in range(4000)).encode()]  # none steady, as differences of steady sound lie on a bound
    equal = total = 0
    for sound in sounds:
        found, plain = audio.fingerprint(sound, tuning).tolist(), plain_fingerprint(sound, tuning)
        assert len(found) == len(plain) > 0
        equal += sum(a == b for a, b in zip(found, plain, strict=True))
        total += len(plain)
    assert equal > 0.99 * total  # single precision may fall on the other side of a bound
    assert len(audio.fingerprint(b"x" * 50)) == 0 and len(audio.fingerprint(None)) == 0
    pitches = np.flatnonzero(audio.folding(tuning).any(1)) * tuning.rate / tuning.frame
    assert audio.folding(tuning).any(0).all() and pitches.max() <= 4200


def test_a_later_start_gives_the_same_integers():
    x = as_bytes(tune(3, 12))
    codes, later = audio.fingerprint(x), audio.fingerprint(x[512 * 7 :])
    assert (codes[7:] == later).mean() > 0.999 and audio.offsets(codes, later)[0] == 7
    assert audio.bit_errors(codes, codes, 0) == (0, len(codes)) and audio.equal_integers(codes, later, 7) == len(later)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_audio_classes_of_documents(spark, folder):
    """The query against all pairs of recordings with enough integers in common, matched at any offset: at
    least nine in ten matching pairs of different recordings are in one class, and no class is made up."""
    docs = pd.read_parquet(f"/root/testdata/{folder}/documents.parquet")
    docs = docs[docs.text.notna()]
    first = {t: d for d, t in reversed(list(zip(docs.doc_id, docs.text, strict=True)))}
    codes = {d: audio.fingerprint(t.encode(), audio.TEXT) for t, d in first.items()}
    where, common = defaultdict(list), Counter()
    for d, own in codes.items():
        for v, n in Counter(own.tolist()).items():
            where[v].append((d, n))
    for there in where.values():
        for i, (a, n) in enumerate(there):
            for b, m in there[i + 1 :]:
                common[a, b] += min(n, m)
    pairs = [(a, b) for (a, b), n in common.items() if n >= 0.32 * max(len(codes[a]), len(codes[b]))]
    pairs = [(a, b) for a, b in pairs if plain_match(codes[a], codes[b], plain_histogram(codes[a], codes[b]))]
    parent = {d: d for d in codes}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = QUERIES["op9_chroma_prints"](spark, f"/root/testdata/{folder}").toPandas()
    own = dict(zip(found.doc_id, found.class_id, strict=True))
    assert sum(own[a] == own[b] for a, b in pairs) >= 0.9 * len(pairs)
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        assert own[d] == own[first[t]] and root(own[d]) == root(first[t])
    assert folder != "sf0.1" or len(pairs) >= 5


def test_similar_texts_without_a_common_sketch_are_one_class(spark, monkeypatch):
    """Classes don't rest on sketches: with one only, which most similar pairs don't share, they equal those of all
    pairs; short texts, copies, nulls and texts without words among them."""
    sketched = neardup.sketches
    monkeypatch.setattr(neardup, "sketches", lambda labelled: sketched(labelled, count=1))
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    data = []
    for k in range(150):
        own = [word() for _ in range(int(rng.integers(1, 60)))]
        cut = own[:-1] if k % 2 and len(own) > 1 else [*own, word()]
        data += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(cut))]
    data += [(400, data[0][1]), (401, ""), (402, "  "), (403, "one"), (404, "one")]
    found = {r["_doc"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame([*data, (500, None)], "doc_id long, text string")).collect()}
    assert found.pop(500) == 500
    assert found == classes_of(dict(data))
    kept = neardup.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(found.values()))


def test_matching_recordings_without_a_common_run_are_one_class(spark, monkeypatch):
    """Recordings whose equal integers never come three in a row, so that they share no sketch, and a crowd
    that begins alike: classes equal those of all pairs at any offset."""
    rng = np.random.default_rng(22)
    codes = {}
    for k in range(60):
        n = int(rng.integers(5, 90))
        x = rng.integers(0, 1 << 32, n).astype(np.uint32)
        x[: n // 4] = np.arange(n // 4)  # the crowd's
        y = x.copy()
        y[k % 3 :: 2] ^= np.uint32(1 << (k % 32))  # every other integer differs in one bit
        codes |= {2 * k: x, 2 * k + 1: y[: n - n // 10]}
    monkeypatch.setattr(audio, "fingerprint", lambda sound, tuning: np.frombuffer(sound, np.uint32))
    data = [(k, x.tobytes()) for k, x in codes.items()]
    found = {r["_doc"]: r["class_id"] for r in audio.recordings(spark.createDataFrame(data, "id long, sound binary"), "id", F.col("sound")).collect()}
    plain = {k: k for k in codes}
    for b in codes:
        for a in range(b):
            if plain[a] != plain[b] and plain_match(codes[a], codes[b], plain_histogram(codes[a], codes[b])):
                x, y = sorted((plain[a], plain[b]))
                plain = {k: x if c == y else c for k, c in plain.items()}
    assert len(set(plain.values())) <= 70
    assert found == plain


def test_recordings_match_at_any_offset():
    """Votes are exact, so that no offset is left out however many have more equal integers."""
    rng = np.random.default_rng(23)
    for kinds, n in ((3, 40), (3, 3000), (50, 500), (1 << 32, 200)):
        x, y = rng.integers(0, kinds, n).astype(np.uint32), rng.integers(0, kinds, n - n // 8).astype(np.uint32)
        exact = plain_histogram(x, y)
        assert audio.votes(x, y).tolist() == [exact[k] for k in range(1 - len(y), len(x))]
    for _ in range(300):
        x, y = rng.integers(0, 6, 12).astype(np.uint32), rng.integers(0, 6, 11).astype(np.uint32)
        assert audio.same_recording(x.tobytes(), y.tobytes()) == plain_match(x, y, plain_histogram(x, y))


def plain_chain(x, y) -> int:
    """Longest common subsequence by a table."""
    row = [0] * (len(y) + 1)
    for a in x:
        last, row = row, [0]
        for k, b in enumerate(y):
            row.append(last[k] + 1 if a == b else max(last[k + 1], row[k]))
    return row[-1]


def plain_shingles(text) -> list:
    return [s for s, _ in labelled(text)]


def plainly_similar(a, b) -> bool:
    x, y = plain_shingles(a), plain_shingles(b)
    m = plain_chain(x, y)
    return m >= 0.8 * (len(x) + len(y) - m) - 1e-9


def test_the_longest_chain_equals_that_of_a_table():
    rng = np.random.default_rng(24)
    for kinds in (1, 2, 4, 30):
        for _ in range(60):
            x, y = (rng.integers(0, kinds, int(rng.integers(1, 90))).astype(np.uint64) for _ in range(2))
            assert neardup.chain(x, y) == plain_chain(x.tolist(), y.tolist())
            z = np.delete(x, rng.integers(0, len(x), 3))
            assert neardup.chain(x, z) == plain_chain(x.tolist(), z.tolist())


def test_one_of_texts_whose_refrain_recurs_once_more_stays(spark):
    """A refrain put before a text moves the labels of all later ones, but nearly all shingles match in order;
    texts of few different words, all pairs: no two that stay are similar."""
    rng = np.random.default_rng(25)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    refrain = " ".join(word() for _ in range(12))
    song = " ".join(f"{refrain} {word()} {word()} {word()}" for _ in range(12))
    data = [(1, song), (2, f"{refrain} {word()} {song}")]
    assert plainly_similar(song, data[1][1])
    for k in range(10, 90):
        own = rng.choice(["ja", "nein", "doch"], 40).tolist()
        data += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[20:23], *own]))]
    kept = {r["doc_id"]: r["text"] for r in neardup.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert 1 in kept and 2 not in kept
    texts = list(kept.values())
    assert not [1 for k, a in enumerate(texts) for b in texts[:k] if plainly_similar(a, b)]
    parent = {d: d for d, _ in data}
    for k, (d, a) in enumerate(data):
        for e, b in data[:k]:
            if parent[d] != parent[e] and plainly_similar(a, b):
                x, y = sorted((parent[d], parent[e]))
                parent = {i: x if c == y else c for i, c in parent.items()}
    assert sorted(kept) == sorted(set(parent.values()))


def test_written_tables_leave_no_shuffle_files(spark):
    """Rounds of recordings once kept all their shuffles on disk until the driver collected garbage."""
    from hypso.llm import common

    def shuffled() -> set:
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = shuffled(), spark.conf.get(setting, None)
    with common.scratch():
        counts = common.written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
        assert not [x for x in shuffled() - before if x.endswith(".data")]
        assert counts.count() == 10 and spark.conf.get(setting, None) == held
