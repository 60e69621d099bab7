"""Chat formatting, embeddings, components and the pipeline."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirflow.llm import chat, components, embeddings, queries

DATA = "/root/testdata/sf0.001"


def read(out):
    return {r.conv_id: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_chat_reads_back(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn:user>\nx\n</turn>\n", "\\l\\e\\g\\\\", "<<>>\\<", "", "\n", "end\n", "🙂 <é>"]
    rows = [(k, t, r, x) for k in range(3) for t, (r, x) in enumerate((r, x) for x in nasty for r in ("user", "assistant", "a>\n<b\\g"))] + [(9, 0, None, None), (9, 1, "assistant", None), (None, 0, "user", "x"), (9, 1, "assistant", None)]
    got = read(chat.format_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for key in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == key)
        assert [(t.role, t.text) for t in got[key].turns] == [x[1:] for x in own]
        assert got[key].loss == "".join(x[2] for x in own if x[1] == "assistant")


def test_chat_layouts(spark):
    two = [("user", "p"), ("assistant", "r")]
    frames = [
        (spark.createDataFrame([(1, "p", "r", 5)], "conv_id int, prompt string, response string, role int"), two),
        (spark.createDataFrame([(1, "s", "p", "r")], "conv_id int, system string, prompt string, response string"), [("system", "s"), *two]),
        (spark.createDataFrame([(1, "p", "q", "r")], "conv_id int, instruction string, input string, output string"), [("user", "p\n\nq"), ("assistant", "r")]),
        (spark.createDataFrame([(1, "p", None, "r")], "conv_id int, instruction string, input string, output string"), two),
        (spark.createDataFrame([(1, [("user", "p"), ("assistant", "r")])], "conv_id int, messages array<struct<role:string,content:string>>"), two),
        (spark.createDataFrame([(1, [("human", "p"), ("gpt", "r")])], "conv_id int, conversations array<struct<from:string,value:string>>"), two),
    ]
    for df, want in frames:
        assert [tuple(t) for t in chat.turns_of(df).first().turns] == want
    with pytest.raises(ValueError):
        chat.turns_of(spark.createDataFrame([(1, "x")], "conv_id int, other string"))
    said = [{"prompt": "p", "response": "r"}, {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]}, {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]}, {"question": "p", "answer": "r", "extra": {"role": 1}}]
    rows = [(k, json.dumps(x)) for k, x in enumerate(said)] + [(7, '{"z": 1}'), (8, None), (9, "broken")]
    got = {r.conv_id: r for r in chat.turns_of_json(spark.createDataFrame(rows, "conv_id int, j string"), "conv_id", "j").collect()}
    assert all([tuple(t) for t in got[k].turns] == two for k in range(4)) and all(got[k].turns is None and got[k].layout is None for k in (7, 8, 9))
    assert chat.path_hash("messages[].role") == spark.range(1).select(F.xxhash64(F.lit("messages[].role")).alias("h")).first().h
    formatted = chat.format_rows(chat.turn_rows(frames[0][0]))
    assert read(formatted)[1].loss == "r"
    assert chat.format_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_the_fingerprint_chooses_the_mapping(spark, monkeypatch):
    want = [(1, 0, "user", "p"), (1, 1, "assistant", "r")]
    frames = [
        spark.createDataFrame([(1, 0, "user", "p", "x"), (1, 1, "assistant", "r", "y")], "conv_id int, turn int, role string, text string, prompt string"),
        spark.createDataFrame([("human", 0, "p", 1, "no"), ("gpt", 1, "r", 1, "no")], "author string, position int, body string, thread_id int, text string"),
        spark.createDataFrame([(1, "p", "r")], "conv_id int, question string, answer string"),
        spark.createDataFrame([(1, [("human", "p"), ("gpt", "r")])], "conv_id int, conversations array<struct<from:string,value:string>>"),
    ]
    for df in frames:
        assert sorted(map(tuple, chat.turn_rows(df).collect())) == want
    for other in ("conv_id int, turn int, role string, words string", "conv_id int, messages array<struct<role:string>>"):
        with pytest.raises(ValueError):
            chat.turn_rows(spark.createDataFrame([], other))
    both = "conv_id int, prompt string, response string, completion string"
    assert chat.turns_of(spark.createDataFrame([(1, "p", "r", "c")], both)).first().turns[1].text == "r"  # of two layouts the first
    monkeypatch.setitem(chat.LAYOUTS, "turn_rows", {"rows": ("conv_id", "turn", "text", "role")})
    assert chat.turn_rows(frames[0]).first().text == "user"


def test_chat_has_no_python(spark):
    plan = queries.op7_chat(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_query(spark):
    import duckdb

    duckdb.sql(f"create or replace view conversations as select * from '{DATA}/conversations.parquet'")
    want, ours = duckdb.sql(queries.OP7_SQL), queries.op7_chat(spark, DATA)
    order = sorted(ours.columns)
    assert sorted(tuple(r[c] for c in order) for r in ours.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
    hostile = ours.where("conv_id = -7").first()
    text = queries.HOSTILE[1]
    assert hostile.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and hostile.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def brute(ids, vectors, threshold=0.95):
    sound = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.asarray(v, float) / np.abs(v).max() / np.linalg.norm(np.asarray(v, float) / np.abs(v).max()) if s else None for v, s in zip(vectors, sound, strict=True)]
    links = [[j for j in range(len(ids)) if j != i and sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(len(ids))]
    part = list(ids)
    for _ in ids:
        new = [min([part[i], *(part[j] for j in near)]) for i, near in enumerate(links)]
        if new == part:
            break
        part = new
    return sorted((i, len(near), c, i == c) for i, near, c in zip(ids, links, part, strict=True))


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "FILL", 16)
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 8))
    vectors = [(centres[k % 12] + r.normal(size=8) * 0.12).tolist() for k in range(240)] + [centres[0].tolist()] * 20 + [(centres[1] * 3).tolist(), centres[1].tolist(), None, [0.0] * 8, [1.0] * 7, [2.0] * 7, [1.0] * 3, [float("nan")] * 8, [None] * 8, [float("inf")] + [0.0] * 7, [1e300] * 8, [1e-300] * 8]
    ids = [int(x) for x in r.permutation(1000)[: len(vectors)]]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, rep int, key string")
    assert sorted(map(tuple, embeddings.near(df).collect())) == brute(ids, vectors)


def test_embeddings_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert embeddings.near(spark.createDataFrame([], kind)).count() == 0
    one = spark.createDataFrame([(3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, None)], kind)
    assert sorted(map(tuple, embeddings.near(one).collect())) == [(3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True)]
    named = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [2.0, 4.0]), (None, [1.0, 2.0]), ("c", [1.0, 2.0, 0.0]), ("d", [])], "name string, v array<double>")
    got = {r.name: (r.n_links, r.component_id, r.kept) for r in embeddings.near(named, id_col="name", vector_col="v").collect()}
    assert got == {"a": (2, "a", True), "b": (2, "a", False), None: (2, "a", False), "c": (0, "c", True), "d": (0, "d", True)}


def test_candidates_leave_out_no_link():
    r = np.random.default_rng(8)
    bits, tables = embeddings.plan(50_000)
    most, planes, lost = embeddings.most_apart(bits, tables, 0.95), embeddings.hyperplanes(64, bits, tables), 0
    for _ in range(2000):
        a, b = r.normal(size=64), r.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b)
        signs = (np.stack([a, b]) @ planes > 0).reshape(2, tables, bits)
        lost += not (signs[0] == signs[1]).all(1).any() or (signs[0] != signs[1]).sum() > most
    assert lost <= 6
    assert embeddings.most_apart(4, 1, 0.95) == 0


def test_tables_reach_their_recall():
    for n in (100, 50_000, 10**9):
        bits, tables = embeddings.plan(n)
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - same) ** tables >= embeddings.RECALL - 1e-12 and n / 2**bits <= 2 * embeddings.FILL or bits == 4


def test_components(spark):
    r = np.random.default_rng(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, int(x)) for x in range(501, 540)] + [(int(a), int(b)) for a, b in r.integers(1000, 1060, (50, 2))] + [(7, 7), (160, 100)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {x: x for e in edges for x in e}
    for _ in part:
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    assert got == part
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA).cache()
        kept.append((name, out.count()))
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert [n for n, _ in kept] == ["quality", "lines", "near copies", "mixing", "packing"]
    assert kept[0][1] >= kept[1][1] >= kept[2][1] > 0
    assert corpus_pipeline.run(spark, DATA).count() == kept[-1][1]


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, cut string, n_lines int, copies int, key string, row long, size int"


def odd_rows():
    """Nulls, one id with several texts, several null ids, repeated rows, long texts, columns with the names of the operators' own."""
    r = np.random.default_rng(3)
    said = lambda n: " ".join(f"w{k}" for k in r.integers(0, 10**6, n))
    passage, copy = said(60), said(80)
    rows = [(1, None), (2, ""), (2, ""), (None, ""), (None, None), (None, said(40)), (None, said(50)), (5, said(30)), (5, said(45)), (7, f"{said(9)} {passage} {said(9)}"), (8, f"{said(7)} {passage} {said(5)}"), (9, copy), (10, f"{copy} end"), (11, copy), (12, said(9000)), (13, "x y"), (14, said(25)), (14, said(25))]
    rows += [(3, said(70))] * 1
    rows += [rows[-1]] * 4
    return [(i, t, "en", ["a", "b", None][k % 3], len(t or ""), "c", 7, 8, "k", 9, 10) for k, (i, t) in enumerate(rows)] + [(3, rows[-1][1], "en", "a", 1, "c", 7, 8, "k", 9, 10)] * 2


def count(rows):
    out = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_stages_of_odd_documents(spark, monkeypatch):
    docs = spark.createDataFrame(odd_rows(), ODD_COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    # quality: what the network keeps, as it is
    from weirflow.llm import quality

    net = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = count(r for r in docs.collect() if net.score(r.text or "", net.tables()) >= 0.5)
    assert count(stages["quality"](spark, docs, DATA).collect()) == want
    # lines: nothing but texts and lengths changes; the second passage goes
    out = stages["lines"](spark, docs, DATA)
    rows = out.collect()
    assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in rows if r.text) and all(r.cut == "c" and r.key == "k" for r in rows)
    by = {r.doc_id: r.text for r in rows}
    assert len(by[7].split()) == 78 and len(by[8].split()) == 12 and 11 not in by and by[10] == "end" and sum(r.doc_id is None for r in rows) == 4
    # near copies: one row of each class by brute force, all rows without words
    left = stages["near copies"](spark, docs, DATA)
    got = count((r.doc_id, r.text or "") for r in left.collect())
    given = count((r.doc_id, r.text or "") for r in docs.collect())
    gone = {k for k in given if k[0] in (10, 11)}
    assert got == {k: 1 if k[1] else n for k, n in given.items() if k not in gone}
    # mixing: every row as often as the operator says for all rows that are the same
    times = {}
    for few in (1024, 2):
        monkeypatch.setattr(corpus_pipeline, "MOST_COPIES", few)
        mixed = count(stages["mixing"](spark, docs, DATA).collect())
        times.setdefault("first", mixed)
        assert mixed == times["first"] and set(mixed) <= set(count(docs.collect()))
    given, words = count(docs.collect()), {}
    for r, n in times["first"].items():
        assert n <= 3 * given[r]
        words[r[3]] = words.get(r[3], 0) + n * len((r[1] or "").split())
    from weirflow.llm import mixing

    targets = {r.source: r.target for r in mixing.mix(docs, with_source=True).collect()}
    assert all(targets[s] - 10_000 <= words.get(s, 0) <= targets[s] + 1 for s in targets)
    # packing: every id of every row once
    pieces = stages["packing"](spark, docs, DATA).collect()
    from weirflow.llm.tokens import encoder
    import public_tokenizers

    own = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(own.encode(r.text or "")) // 4 + 1 for r in docs.collect())


def test_pipeline_runs_on_odd_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), ODD_COLUMNS)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    for name, df, marks in (("odd", docs, labels), ("none", docs.limit(0), labels), ("unlabelled", docs, labels.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        step = df
        for _, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, f"{tmp_path}/{name}")
        same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        assert count(out.select(same).collect()) == count(step.select(same).collect())
        assert (out.count() > 0) == (name != "none")


@pytest.mark.parametrize("name", ["op2_ngram_join", "op6_embeddings"])
def test_queries_as_sql(spark, name):
    import duckdb

    for table in ("documents", "embeddings"):
        duckdb.sql(f"create or replace view {table} as select * from '{DATA}/{table}.parquet'")
    want, ours = duckdb.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, DATA)
    order = sorted(ours.columns)
    assert sorted(tuple(r[c] for c in order) for r in ours.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


#: What SQL can say of three queries whose other columns it can't.
PARTS = {
    "op3_fingerprints": r"""select doc_id, length(t) as n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(following, 1, length(t) // 4)) as edited_sha256 from (
        select doc_id, t, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as following from (select doc_id, coalesce(text, '') as t from documents))""",
    "op5_pii": r"""select doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
        len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: cast(p as hugeint) > 255)) = 0)) as n_ip,
        len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 9 and 15)) as n_phone
        from (select doc_id, coalesce(text, '') as t from documents)""",
    "op8_mixing": r"""select doc_id, size, cast(sum(size) over (partition by source) as bigint) as source_size from (
        select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents)""",
}


@pytest.mark.parametrize("name", sorted(PARTS))
def test_columns_that_sql_can_say(spark, name):
    import duckdb

    duckdb.sql(f"create or replace view documents as select * from '{DATA}/documents.parquet'")
    want = duckdb.sql(PARTS[name])
    ours = queries.queries()[name](spark, DATA).select(want.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(want.fetchall())
