"""Operators on texts against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weirflow.llm import fingerprints, lines, mixing, ngrams, packing, pii, quality, shingles, token_files, tokens
from weirflow.llm.tokens import encoder, split

DATA = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "a\n\n b", "\n", "x \n y", "a\n \nb", "don't we'll I'M", "ΑΣ Σ ÀÉ é ﬁ Ⅷ ½ x²", "tab\tsep nb em", "\x1c a\x1db", "<|endoftext|> hi <|startoftext|>", "<|ENDOFTEXT|> x", "日本語テキスト 中文", "a" * 3000, "!!??..  --", "١٢٣ 123 4567", " lead", "trail ", "\r\nwin\r\n", "🙂🙃 x", "İstanbul ẞ", "end. Next! (x), y.z"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those inside."""
    rows = [(1, None, "a"), (2, "", None), (3, "one two three four five six. " * 20, "a"), (4, "one two three four five six. " * 20, "b"), (4, "one two three four five six. " * 20, "b"), (None, "x y z", None), (5, "word " * 20_000, "c"), (6, "x", "d")]
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "doc_id long, text string, source string, n int, rep string, bucket int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(docs, name):
    own, library = encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    r = random.Random(3)
    made = ["".join(r.choice("ab Z'é.,!\n \t ßİ́Σ1٢_-<|>\x1c\x1f\x0b\x85ªµǅʼ") for _ in range(r.randint(0, 25))) for _ in range(5000)]
    rows = [*ODD, *made, *(x.text for x in docs.select("text").collect()), None]
    for text, ids in zip(rows, split(*own.encode_all(pa.array(rows))), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text[:60]
    assert [len(x) for x in split(*own.encode_all(pa.array(["<|endoftext|>", "a", "<|endoftext|>"])))] == [1, 1, 1]


def test_tables_of_stretches_turn_over(docs, monkeypatch):
    monkeypatch.setattr(tokens, "MOST", 50)
    monkeypatch.setattr(tokens, "AT_A_TIME", 3000)
    own, library = tokens.WordEnds(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [x.text for x in docs.select("text").collect()]
    assert [x.tolist() for x in split(*own.encode_all(pa.array(rows)))] == [library.encode(t, add_special_tokens=False).ids for t in rows]


def test_room_tree():
    r = random.Random(5)
    for _ in range(60):
        window = r.choice([7, 8, 64])
        lengths = [r.randint(1, window) for _ in range(r.randint(0, 80))]
        at, offset, n = packing.best_fit(lengths, window)
        rooms, want = [], {}
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [s for s, room in enumerate(rooms) if room >= lengths[k]]
            best = min((rooms[s] for s in fits), default=None)
            assert (best is None) == (offset[k] == 0 and at[k] not in want)
            if best is None:
                rooms.append(window)
            else:
                assert rooms[at[k]] == best  # the tightest
            assert offset[k] == window - rooms[at[k]]
            rooms[at[k]] -= lengths[k]
            want[at[k]] = True
        assert n == len(rooms) and min(rooms, default=0) >= 0


@pytest.mark.parametrize("source", ["docs", "edge"])
def test_packing(request, source):
    df = request.getfixturevalue(source)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(df, path, 1, rows_per_group=50).toPandas()
    fill = rows.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048
    placed = rows.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    encode, want = encoder(path).encode, {}
    for r in df.collect():
        ids = encode(r.text or "") + (1).to_bytes(4, "little")
        for start in range(0, len(ids) // 4, 2048):
            part = ids[4 * start : 4 * start + 8192]
            key = (r.doc_id, start, len(part) // 4, zlib.crc32(part), len(ids) // 4)
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows.itertuples():
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
    assert got == want
    assert packing.pack_documents(df.limit(0), path, 1).count() == 0


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (200, 1 << 10, 1 << 20, 1 << 32):
            ranks = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            control, data = token_files.encode_block(ranks)
            assert len(control) == -(-n // 4) and (token_files.decode_block(control, data, n) == ranks).all()
    assert len(token_files.encode_block(np.zeros(8, np.uint32))[1]) == 8


@pytest.mark.parametrize("source", ["docs", "edge"])
def test_token_files(request, tmp_path, source):
    df = request.getfixturevalue(source)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_files.token_files(df, path, 2, str(tmp_path / "files")).collect()
    encode = encoder(path).encode
    want = sorted((r.doc_id is not None, r.doc_id or 0, encode(r.text or "") + (2).to_bytes(4, "little")) for r in df.collect())
    got = sorted(rows, key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((a, b, len(x) // 4, zlib.crc32(x)) for a, b, x in want)
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert token_files.token_files(df.limit(0), path, 2, str(tmp_path / "none")).count() == 0


def test_fingerprints(docs):
    got = sorted(fingerprints.fingerprint_documents(docs).collect(), key=lambda r: r.doc_id)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    marks = {}
    for k, (r, text) in enumerate(zip(got, texts, strict=True)):
        following = texts[(k + 1) % len(texts)]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == str(fingerprints.fingerprint(text)) and r.edited_fingerprint == str(fingerprints.fingerprint(changed))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(marks.values())) == len(marks)
    assert np.mean([r.near_edited for r in got]) > 0.6 > 0.2 > np.mean([r.near_next for r in got])


def test_fingerprints_add_up():
    a, b = "one two three\nfour five six seven eight nine", "ten"
    whole = fingerprints.fingerprint(f"{b}\n{a}")
    assert whole == fingerprints.fingerprint(a) + fingerprints.fingerprint(b) == fingerprints.fingerprint(f"{a}\n{b}")
    assert whole - fingerprints.fingerprint(b) == fingerprints.fingerprint(a) == fingerprints.Fingerprint.parse(str(fingerprints.fingerprint(a)))
    assert fingerprints.fingerprint("a\na") != fingerprints.fingerprint("a") and fingerprints.fingerprint("").likeness(fingerprints.fingerprint("")) == 1


def word_hash(word):
    """A word's hash, a byte at a time."""
    h = 0
    for b in reversed(word.encode()):
        h = (h * int(shingles.BASE) + int(shingles.LETTERS[b])) % 2**64
    return int(shingles.mixed(np.array([h], np.uint64))[0])


def plain_fingerprint(text):
    """A text's lanes, a paragraph and a run of words at a time."""
    mask, equal, like = (1 << 64) - 1, [0] * fingerprints.EQUAL, [0] * fingerprints.LIKE
    for p in text.split("\n") if text else ():
        digest = hashlib.blake2b(p.encode(), digest_size=64).digest()
        equal = [(a + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) & mask for k, a in enumerate(equal)]
        words = p.split()
        for at in range(max(1, len(words) - 4)) if words else ():
            run = 0
            for k in range(5):
                run = (run * 0x9E3779B97F4A7C15 + (word_hash(words[at + k]) if at + k < len(words) else 0)) & mask
            run = ((run ^ run >> 31) * 0xBF58476D1CE4E5B9) & mask
            like[run >> 56] += 1 if run >> 55 & 1 else -1
    return equal, like


def test_fingerprints_against_plain_sums(docs, edge):
    for text in [*ODD, *(r.text or "" for r in docs.limit(30).collect()), "one two three\n\nfour five six seven eight nine ten\n a"]:
        own = fingerprints.fingerprint(text)
        assert (own.equal.tolist(), own.like.tolist()) == plain_fingerprint(text), text[:50]
    many = fingerprints.fingerprint("word " * 40_000)
    assert many.likeness(fingerprints.fingerprint("word " * 30_000)) == 1


def test_fingerprints_of_one_id_are_dealt(spark):
    rows = [(5, f"text {k} of one id") for k in range(300)] + [(None, f"no id {k}") for k in range(200)] + [(7, "the same")] * 300 + [(k, f"own {k}") for k in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = [r["count"] for r in fingerprints.ranged(df, 12).groupBy("bucket").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 150 and len(sizes) >= 9
    got = fingerprints.fingerprint_documents(df).collect()
    ordered = [(r.doc_id, r.text) for r in df.orderBy(F.asc_nulls_last("doc_id"), F.shiftright(F.xxhash64("text"), 11)).collect()]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + ordered[(k + 1) % 1000][1][: len(t) // 4]).encode()).hexdigest() for k, (_, t) in enumerate(ordered))
    assert sorted(r.edited_sha256 for r in got) == want and len(got) == 1000


def test_fingerprints_of_odd_tables(edge):
    rows = fingerprints.fingerprint_documents(edge).collect()
    assert len(rows) == edge.count() and {r.n_chars for r in rows if r.doc_id in (1, 2)} == {0}
    only = fingerprints.fingerprint_documents(edge.where("doc_id = 3")).collect()
    assert len(only) == 1 and only[0].near_next == 1
    assert fingerprints.fingerprint_documents(edge.limit(0)).count() == 0


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_are_those_of_the_patterns(docs):
    r = random.Random(1)
    made = ["".join(r.choice("a1.@+- (2)45,\n") for _ in range(r.randint(0, 40))) for _ in range(20_000)]
    made += ["".join(r.choice("4111 -.+@0") for _ in range(r.randint(10, 60))) for _ in range(5000)]
    for text in [*made, *(x.text for x in docs.collect())]:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute(text)


def test_pii(spark, docs, edge):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for r in docs.collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(r.text))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[r.doc_id].spans.split(",")) or not base
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in brute(r.text)) for k in pii.KINDS]
    assert pii.find(edge).count() == edge.count() and pii.find(edge.limit(0)).count() == 0
    assert pii.find(edge.select("text", "doc_id", F.lit("a@b.cd").alias("spans"))).count() == edge.count()
    rows = [(k, f"write an email to ann.b{k}@mail.example.com today or call phone +1 555 123 45{k % 10}0 now") for k in range(40)] + [(100, "call my phone 555-123-4567 now"), (101, "order invoice 555-123-4567 page"), (102, "mail ann (at) example (dot) com")]
    some = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert some[0].n_email == 1 and some[0].n_phone == 1 and some[102].spans.startswith("email:")
    assert some[100].spans == "phone:14:26" and some[101].spans == ""


def planted(r):
    """(text, spans to add) of base data, of personal data that the base patterns miss, and of what only looks like it."""
    n = lambda k: "".join(r.choice("123456789") for _ in range(k))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8)))

    def card():
        own = "4" + n(14)
        return next(own + c for c in "0123456789" if pii.luhn(own + c))

    rows = []
    for _ in range(150):
        rows += [(f"write an email to {name()}.{n(2)}@mail.example.com please", None), (f"our server {n(2)}.1{n(2)}.{n(2)}.{n(1)} is down", None), (f"my card is {card()} now", None), (f"call +1 (415) 555-{n(4)} today", None)]
    for _ in range(40):
        a, b = r.choice(["()", "[]", "{}"])
        c = card()
        good = [(0, "please mail ", f"{name()} {a}at{b} {name()} {a}dot{b} com"), (0, "contact me ", f"{name()} at {name()} dot org"), (0, "my email is ", f"{name()}.{name()}[at]{name()}.net"), (1, "from client ", f"{n(2)}[.]1{n(2)}[.]{n(2)}[.]{n(1)}"), (1, "the server address ", ":".join(f"{r.randrange(4096, 65536):x}" for _ in range(8))), (2, "my visa card ", ".".join(c[k : k + 4] for k in range(0, 16, 4))), (3, "call my phone ", f"{n(3)}-{n(3)}-{n(4)}"), (3, "tel ", f"({n(3)}) {n(3)}-{n(4)}"), (3, "her mobile ", f"0049 {n(3)} {n(4)} {n(2)}")]
        for kind, before, said in good:
            text = f"{name()} {before}{said} {name()}"
            rows.append((text, (pii.KINDS[kind], text.index(said), text.index(said) + len(said))))
        bad = [("order ", f"{n(3)}-{n(3)}-{n(4)}"), ("invoice ", f"{n(3)}-{n(3)}-{n(4)}"), ("isbn ", f"{n(3)} {n(3)} {n(4)}"), ("build ", f"x{n(3)}-{n(3)}-{n(4)}z"), ("section id ", ".".join(n(4) for _ in range(4))), ("sku ", "_".join("9" + n(3) for _ in range(4))), ("version ", f"9{n(2)}[.]7{n(2)}[.]3{n(2)}[.]9{n(2)}"), ("see page ", f"{name()} at {name()} dot {name()}x")]
        rows += [(f"{name()} {before}{said} {name()}", None) for before, said in bad]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_added_spans_are_right_and_most_are_found(spark, seed):
    rows = planted(random.Random(seed))
    out = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    added = right = wanted = 0
    for k, (text, want) in enumerate(rows):
        base = {(kind, a, b) for kind, a, b in brute(text)}
        got = {(x.split(":")[0], *map(int, x.split(":")[1:])) for x in out[k].split(",") if x} - base
        added, wanted = added + len(got), wanted + (want is not None)
        right += want in got
    assert wanted == 360 and right / added >= 0.9 and right / wanted >= 0.9, (added, right, wanted)


def test_linear_time_on_long_runs():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 100_000, "+1" * 100_000, "1." * 150_000):
        pii.proposed(text, pii.base_spans(text))
    took = []
    for n in (10_000, 40_000):
        text, at = "x 4111 1111 1111 1111 call 555-123-4567 " * n, time.time()
        assert len(pii.proposed(text, pii.base_spans(text))) == n
        took.append(time.time() - at)
    assert time.time() - began < 40 and took[1] < 12 * took[0]


def line_bounds(text):
    """Where the lines of a text that have words begin and end."""
    out, at = [], 0
    for row in text.split("\n"):
        place = 0
        while place < len(row):
            end = re.compile(r"[.!?]\s+").search(row, place)
            stop = end.end() if end else len(row)
            if not row[place:stop].isspace():
                out.append((at + place, at + stop))
            place = stop
        at += len(row) + 1
    return out


def test_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "PART", 1 << 9)
    keys = spark.range(3000).select((F.col("id") * 7 - 9).alias("a"), F.xxhash64("id").alias("b"))
    bits = lines.filter_of(keys)
    assert len(bits) == (1 << 15) // 8 and keys.mapInArrow(lines.maybe(bits, (0, 1)), keys.schema).count() == 3000
    others = spark.range(3000, 13_000).select((F.col("id") * 7 - 9).alias("a"), F.xxhash64("id").alias("b"))
    assert others.mapInArrow(lines.maybe(bits, (0, 1)), keys.schema).count() < 2000
    assert lines.filter_of(keys.limit(0)).sum() == 0


def texts_of_white_space():
    r = random.Random(1)
    return ["".join(r.choice("ab. \n\t!?é\u2003\u3000\x85\x1c\xa0") for _ in range(r.randint(0, 30))) for _ in range(3000)] + [None, "", "x" * 3000]


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_words(monkeypatch, at_once):
    monkeypatch.setattr(shingles, "AT_ONCE", at_once)
    monkeypatch.setattr(shingles, "AHEAD", shingles.powers(shingles.BASE, at_once + 1))
    monkeypatch.setattr(shingles, "BACK", shingles.powers(shingles.INVERSE, at_once + 1))
    rows = texts_of_white_space()
    words = shingles.words_of(pa.array(rows))
    ends, sets = np.cumsum(words.counts), shingles.shingles_of(words)
    for text, n, e, own in zip(rows, words.counts, ends, sets, strict=True):
        said = (text or "").split()
        hashes = [word_hash(w) for w in said]
        assert words.hashes[e - n : e].tolist() == hashes and words.line_ends[e - n : e].sum() == len(line_bounds(text or ""))
        runs = {tuple(hashes[a : a + 5]) for a in range(max(1, n - 4))} if n else set()
        assert len(own) == len(runs)
        want = set()
        for run in runs:
            h = len(run)
            for x in run:
                h = (h * int(shingles.BASE) + x) % 2**64
            want.add(int(shingles.mixed(np.array([h], np.uint64))[0]))
        assert set(own.tolist()) == want


def test_whole_lines_against_brute_force(docs):
    rows = sorted(lines.dedup(docs).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen: dict = {}
    for r in rows:
        text = texts[r.doc_id]
        bounds = line_bounds(text)
        h, words = [" ".join(text[a:b].split()) for a, b in bounds], [len(text[a:b].split()) for a, b in bounds]
        borders = [0, *(a for a, _ in bounds[1:]), len(text)]
        cuts = [tuple(map(int, x.split(":"))) for x in r.cut.split(",")] if r.cut else []
        gone = [any(a <= borders[k] and borders[k + 1] <= b for a, b in cuts) for k in range(len(h))]
        left, at = [], 0
        for a, b in cuts:
            left.append(text[at:a])
            at = b
        assert r.text == "".join(left) + text[at:] and r.n_cut == sum(gone) and r.n_lines == len(h)
        total, had = np.concatenate([[0], np.cumsum(words)]), [False] * len(h)
        for a in range(len(h)):
            for e in range(a + 1, len(h) + 1):
                if total[e] - total[a] >= lines.RUN:
                    # the shortest runs with enough words, from each line on and up to each line
                    if total[e - 1] - total[a] < lines.RUN or total[e] - total[a + 1] < lines.RUN:
                        if seen.setdefault(tuple(h[a:e]), (r.doc_id, a)) < (r.doc_id, a):
                            had[a:e] = [True] * (e - a)
                    if total[e - 1] - total[a] >= lines.RUN and total[e] - total[a + 1] >= lines.RUN:
                        break
        assert gone == had, r.doc_id  # what stood before goes, and nothing else


def test_line_dedup_of_odd_tables(spark, edge):
    got = lines.dedup(edge)
    assert got.columns == [*edge.columns, "n_lines", "n_cut", "cut"] and got.count() == edge.count()
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[(1, "a")].text is None and by[(2, None)].text == "" and by[(4, "b")].text == "" and by[(3, "a")].n_cut == 19
    assert lines.dedup(edge.limit(0)).count() == 0
    passage = "This passage stands in many places and has more than fifty words in it. " * 1 + " ".join(f"word{k}" for k in range(45)) + "."
    rows = [(k, f"Own beginning number {k} of the text.\n{passage}\nAnd an end {k} too.") for k in range(5)] + [(9, "Clean text of its own.")]
    out = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    named = {r.name: r.text for r in lines.dedup(spark.createDataFrame([(f"d{k}", t) for k, t in rows], "name string, text string"), id_col="name", whole_lines=False).collect()}
    assert sum(passage in t for t in named.values()) == 1 and len(named) == 6
    assert passage in out[0] and all("passage" not in out[k] and "Own beginning" in out[k] and f"end {k}" in out[k] for k in range(1, 5)) and out[9] == "Clean text of its own."


def uncut(rows, run=lines.RUN):
    """For each text, the words in windows of run words that stood before, by brute force."""
    seen, out = set(), []
    for text in rows:
        words = (text or "").split()
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - run + 1):
            window = tuple(words[k : k + run])
            if window in seen:
                gone[k : k + run] = True
            seen.add(window)
        out.append(" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
    return out


def check_words(df):
    rows = sorted(lines.dedup(df, whole_lines=False).collect(), key=lambda r: r.doc_id)
    was = [r.text for r in df.orderBy("doc_id").collect()]
    assert [" ".join((r.text or "").split()) for r in rows] == uncut(was)
    assert [r.cut != "" for r in rows] == [" ".join((r.text or "").split()) != " ".join((t or "").split()) for r, t in zip(rows, was, strict=True)]


def test_passages_that_begin_and_end_within_lines_are_cut(spark):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for k in range(40):
        passage = [word() + ("." if j % 18 == 17 else "") for j in range(51 - k % 22)]
        for j in range(2):
            rows.append((2 * k + j, " ".join([*(word() for _ in range(8)), *passage, *(word() for _ in range(7))]) + "."))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_words(df)
    out = {r.doc_id: r.text for r in lines.dedup(df, whole_lines=False).collect()}
    assert all(len(out[k].split()) == (15 if k % 2 else len(dict(rows)[k].split())) for k in out)


def test_words_against_brute_force(docs):
    check_words(docs)


@pytest.mark.parametrize("whole_lines", [True, False])
def test_longer_passages_around_a_frequent_line_are_cut(spark, whole_lines):
    rows = []
    for k in range(12):
        a, b, c = (" ".join(f"k{k}s{j}w{i}" for i in range(30)) + "." for j in range(3))
        rows += [(10 * k, b), (10 * k + 1, f"{a} {b} {c}"), (10 * k + 2, f"{a} {b} {c}")]
    out = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole_lines=whole_lines).collect()}
    for k in range(12):
        assert len(out[10 * k].split()) == 30 and len(out[10 * k + 1].split()) == 60 and out[10 * k + 2] == ""


def brute_links(texts):
    sets = [set(shingles.shingle_hashes(t or "").tolist()) for t in texts]
    return [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9] for i, a in enumerate(sets)]


def check_join(df):
    rows = df.select("doc_id", "text").collect()
    links = brute_links([r.text for r in rows])
    part = list(range(len(rows)))
    for _ in rows:
        new = [min([part[i], *(part[j] for j in near)], key=lambda k: (rows[k].doc_id is not None, rows[k].doc_id or 0)) for i, near in enumerate(links)]
        if new == part:
            break
        part = new
    want = sorted((str(r.doc_id), str(rows[part[i]].doc_id), len(links[i])) for i, r in enumerate(rows))
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngrams.ngram_join(df).collect()) == want


def test_ngram_join(docs, monkeypatch):
    check_join(docs)
    monkeypatch.setattr(ngrams, "BLOCK", 2)  # buckets in several blocks
    check_join(docs)


def test_ngram_join_of_odd_tables(spark, edge):
    check_join(edge.where("doc_id is not null").distinct())
    assert ngrams.ngram_join(edge).count() == edge.count() and ngrams.ngram_join(edge.limit(0)).count() == 0


def near_texts(word, n):
    """Texts of which each is a near copy of the others, none equal."""
    return [" ".join([*(f"{word}{i}" for i in range(60)), f"{word}end{k}"]) for k in range(n)]


def test_ngram_join_of_null_and_repeated_ids(spark, edge):
    check_join(edge)
    a, b, c, d = (near_texts(w, 3) for w in "abcd")
    rows = [*((None, t) for t in a), (7, b[0]), (7, b[1]), (8, b[2]), (8, b[2]), (7, c[0]), (9, c[1]), (9, d[0]), (9, "alone " * 9)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"))
    mixed = spark.createDataFrame([(None, d[0]), (None, d[1]), (5, d[2])], "doc_id long, text string")
    assert sorted((r.n_links, r.class_id) for r in ngrams.ngram_join(mixed).collect()) == [(2, 5)] * 3


def test_near_copies_stage_keeps_documents_without_ids_of_their_own(spark):
    a, b, c, d, e = (near_texts(w, 2) for w in "abcde")
    rows = [(None, a[0]), (None, a[1]), (None, b[0]), (None, b[0]), (None, ""), (None, ""), (None, None), (4, c[0]), (4, d[0]), (4, d[0]), (5, d[1]), (None, d[1]), (6, e[0])]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_copies_stage(spark, df, "")
    got = sorted((str(r.doc_id), r.text or "") for r in left.collect())
    first = next(t for _, t in got if t in a)  # of one id, either
    assert got == sorted([("None", first), ("None", b[0]), *[("None", "")] * 3, ("4", c[0]), ("4", d[0]), ("6", e[0])])
    assert corpus_pipeline.near_copies_stage(spark, df.repartition(5), "").exceptAll(left).count() == 0
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mixing_stage(spark, left, "").collect()]
    assert max(mixed.count(m) for m in mixed if m[1]) <= mixing.CEILING


def test_bands_reach_their_recall():
    r, bands = np.random.default_rng(2), ngrams.bands_for(0.8, 0.99)
    by, hits = ngrams.multipliers(bands * ngrams.ROWS), 0
    for _ in range(300):
        pool = r.integers(0, 1 << 63, 1800, dtype=np.uint64)
        a, b = ngrams.band_keys(pool[:1600], bands, ngrams.ROWS, by), ngrams.band_keys(pool[200:], bands, ngrams.ROWS, by)  # 1400 of 1800
        hits += (a == b).any()
    assert hits >= 285


def test_fit(monkeypatch):
    r = random.Random(9)
    for k in range(2000):
        monkeypatch.setattr(mixing, "FIRST", r.choice([1, 8, 64, 1 << 14]))
        sizes = sorted(r.sample(range(0, 60), r.randint(1, 12)))
        if k % 3 == 0:
            sizes = [6 * x for x in sizes]
        counts = [r.randint(1, 4) for _ in sizes]
        sums = {0}
        for s, n in zip(sizes, counts, strict=True):
            sums = {x + s * j for x in sums for j in range(n + 1)}
        budget = r.randint(0, max(sums) + 5)
        take = mixing.fit(sizes, counts, budget)
        assert all(0 <= t <= n for t, n in zip(take, counts, strict=True))
        assert sum(s * t for s, t in zip(sizes, take, strict=True)) == max(x for x in sums if x <= budget)


def test_fit_is_bounded_with_a_very_long_text():
    import tracemalloc

    tracemalloc.start()
    sizes = [*range(2, 24_002, 2), 6_000_000]
    counts = [1] * len(sizes)
    budget = sum(sizes) // 2 | 1
    take = mixing.fit(sizes, counts, budget)
    assert sum(s * t for s, t in zip(sizes, take, strict=True)) == budget - 1 and tracemalloc.get_traced_memory()[1] < 500e6
    odd = [*range(3, 3003, 3), 6_000_001]  # the common divisor is 1, the budget can't be met
    take = mixing.fit(odd, [1] * len(odd), 1_000_000)
    assert sum(s * t for s, t in zip(odd, take, strict=True)) == 999_999 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    got = mixing.targets([10, 1000, 0], [3, 1, 2])
    assert got == pytest.approx([30, 980, 0])
    assert mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0]


def test_mixing(docs, edge):
    for df in (docs, edge):
        rows = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(7)).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == df.count()
        assert all(0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in rows)
    source = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    taken, target = {}, {}
    for r in mixing.mix(docs).collect():
        name, text = source[r.doc_id]
        assert r["size"] == len(re.findall("[^\x20\x09-\x0d]+", text))
        taken[name], target[name] = taken.get(name, 0) + r.taken, r.target
    assert sum(target.values()) == pytest.approx(sum(len(re.findall("[^\x20\x09-\x0d]+", t)) for _, t in source.values()))
    assert all(abs(taken[s] - target[s]) <= 60 for s in taken)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_without_sending_shares(docs, monkeypatch):
    key = lambda r: tuple(map(str, r))
    want = sorted(map(key, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "SENT", 0)
    assert sorted(map(key, mixing.mix(docs).collect())) == want


def test_network_gradients():
    net = quality.Network(3)
    seen, labels = [quality.symbols("some text that is long enough " * 20), quality.symbols("x!! y!! z!!")], [1, 0]
    grads = net.gradients(seen, labels)

    def loss():
        tables, out = net.tables(), 0.0
        for (b, echo), y in zip(seen, labels, strict=True):
            z = net.features(net.chunks(b, echo, tables)[0]) @ net.p["out"] + net.p["out_bias"][0]
            out += np.log1p(np.exp(-z if y else z))
        return out / len(labels)

    for name, at in (("out", 3), ("out_bias", 0), ("bias", 2), ("filters", (2, 1, 4)), ("byte", (ord("t"), 2))):
        kept = net.p[name][at]
        net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
        net.p[name][at] = kept + 1e-4
        up = loss()
        net.p[name][at] = kept - 1e-4
        slope = (up - loss()) / 2e-4
        net.p[name][at] = kept
        assert slope == pytest.approx(float(grads[name][at]), abs=2e-3)


def test_chunks_cover_the_text():
    net = quality.Network(1)
    tables = net.tables()
    text = "ab cd " * 5000
    b, echo = quality.symbols(text)
    whole = net.windows(b, echo, tables)
    assert np.allclose(net.chunks(b, echo, tables)[0].max(0), whole.max(0)) and len(whole) >= (len(text) - quality.WIDTH) / quality.STRIDE


def test_quality(spark, docs, edge):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    big = "/root/testdata/sf0.01"
    more = quality.classify(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in more]) > 0.95
    assert quality.classify(edge, labels.limit(0)).count() == edge.count()
    assert all(r.score == pytest.approx(0.5) for r in quality.classify(edge, labels.limit(0)).collect())
    assert quality.classify(edge.limit(0), labels).count() == 0
    net = quality.Network(1)
    assert quality.keep_good(edge, net).columns == edge.columns


def plain_score(net, text):
    """The network's score of a text, window by window and without its tables."""
    raw = text.encode("utf-8", "replace")
    size = max(quality.WIDTH, quality.WIDTH + -(-(len(raw) - quality.WIDTH) // quality.STRIDE) * quality.STRIDE)
    echo, last = [0] * size, {}
    for k in range(len(raw) - 2):
        gap = k - last.get(raw[k : k + 3], -(1 << 40))
        echo[k + 2] = sum(gap <= 2**j for j in range(3, 10))
        last[raw[k : k + 3]] = k
    raw += bytes(size - len(raw))
    windows = []
    for at in range(0, size - quality.WIDTH + 1, quality.STRIDE):
        v = net.p["bias"].astype(float).copy()
        for k in range(quality.WIDTH):
            v += (net.p["byte"][raw[at + k]] + net.p["echo"][echo[at + k]]).astype(float) @ net.p["filters"][k]
        windows.append(np.maximum(v, 0))
    chunks = np.asarray([np.max(windows[k : k + quality.WINDOWS], 0) for k in range(0, len(windows), quality.WINDOWS)])
    z = chunks.max(0) @ net.p["out"] + net.p["out_bias"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_the_network(spark, docs, edge):
    net = quality.Network(5)
    net.p["out"] *= 20
    for df in (docs.limit(12), edge.where("doc_id < 4")):
        want = {r.doc_id: plain_score(net, r.text or "") for r in df.collect()}
        got = {r.doc_id: r.score for r in quality.score(df, net).collect()}
        assert got == pytest.approx(want, abs=1e-5) and len(set(got.values())) > 1


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(5, f"text {k} " * 30) for k in range(60)] + [(6, "same words " * 40)] * 60 + [(7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    seen = []
    train = quality.Network.train

    def spy(self, labelled, *a, **b):
        seen.append(labelled)
        return train(self, labelled, 1)

    quality.Network.train = spy
    try:
        quality.fit(docs, labels, most_rows=20, most_chars=3000)
    finally:
        quality.Network.train = train
    assert all(len(x) <= 20 and sum(len(t) for t, _ in x) <= 3000 for x in seen)
