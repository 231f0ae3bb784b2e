"""Hand-written cases of the conversation operators."""

import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colloquy import providers
from colloquy.functions.fixed import PATIENT_FORMS, SPOKEN_FORMS
from colloquy.operators import chunks, clean, cluster, parse, punctuation, roles, sections, sentences, tree, vectors
from colloquy.plans import catalogue
from colloquy.plans.preprocess import preprocess
from colloquy.sources import csv, ontology
from colloquy.sources.tables import require_columns
from colloquy.streaming import dialogues


@pytest.fixture(scope="module")
def apply(spark):
    """A Column function over one text or a list of them."""
    def run(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("r")).orderBy("i").collect()
        out = [r.r for r in rows]
        return out[0] if len(texts) == 1 else out

    return run


def said(rows):
    return None if rows is None else [(u.role, u.text) for u in rows]


@pytest.mark.parametrize(
    ("task", "text", "want"),
    [
        ("C", "[doctor] hi , how are you ?\n[patient] ok .", [("[doctor]", " hi , how are you ?"), ("[patient]", " ok .")]),
        ("C", "so [doctor] hi", [("[doctor]", "so  hi")]),
        ("C", "no tag\n\n[doctor]\n[doctor] ", [("[doctor]", " ")]),
        ("C", "[doc\rtor] hi\r\n[patient] yes", [("[doc\rtor]", " hi\r"), ("[patient]", " yes")]),
        ("C", "", []),
        ("C", None, None),
        ("A", "Doctor: hi\r\nPatient: yes: maybe\r\nno role", [("Doctor", " hi"), ("Patient", " yes: maybe")]),
        ("B", "Doctor: a\nPatient: b", [("Doctor", " a\nPatient: b")]),
        ("A", "doctor: a", []),
        ("D", "[doctor] hi", []),
    ],
)
def test_parse(apply, task, text, want):
    assert said(apply(lambda c: parse.utterances(c, task), text)) == want


def test_parse_of_several_tags(apply):
    two = "[a] x [b] y\n[c] z"
    with pytest.raises(PySparkException, match="several roles"):
        apply(parse.utterances, two)
    assert said(apply(lambda c: parse.utterances(c, on_invalid="drop"), two)) == [("[c]", " z")]
    assert said(apply(lambda c: parse.utterances(c, on_invalid="keep"), two)) == [("[a]", " x [b] y"), ("[c]", " z")]
    assert apply(parse.invalid_lines, two) == 1
    assert said(apply(lambda c: parse.utterances(c, exceptions=[("(", "["), (")", "]")]), "(a) x")) == [("[a]", " x")]


def test_spoken_forms(apply):
    got = apply(clean.replace_all, "her", "there", "number", "wasn't", "doesn't", "I've", "[patient_guest]", "[caregiver]", None)
    assert got == ["h", "the", "nb", "wasnot", "doesnot", "I've", "[patient_guest]", "[caregiv]", None]
    assert len(SPOKEN_FORMS) == 58 and len(PATIENT_FORMS) == 13


def test_repeats(apply):
    got = apply(clean.collapse_repeats, "the the the end", "A a", "it's s", "ha-ha ha", "doctor\n[doctor] hi", "[doctor] doctor smith", "½ ½ x", None)
    assert got == ["the end", "A a", "it's", "ha", "doctor] hi", "[doctor smith", "½ x", None]
    assert apply(lambda c: clean.collapse_repeats(c, "line_body"), "[doctor] doctor doctor smith\n[a] smith a a") == "[doctor] doctor smith\n[a] smith a"


def test_repeats_equal_a_restatement(apply):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "ab", " ", ", ", "\n", "é", "_", "1", "-", "[a] "]) for _ in range(30)) for _ in range(300)]
    assert apply(clean.collapse_repeats, *texts) == [re.sub(r"\b(\w+)(?:\W+\1\b)+", r"\1", t) for t in texts]


def test_patient_lines(apply):
    p = lambda t: "[patient] " + t
    cases = {
        p("I have pain in My back"): p("the patient has pain in his / her back"),
        p("I'm ok"): p("the patient is ok"),
        p("well , you know , I think"): p("well ,, the patient think"),
        p("I'd say I've told me"): p("the patient would say the patient has told the patient"),
        p("éi mi I"): p("éi mi the patient"),
        "[doctor] I have it": "[doctor] I have it",
        "[patient]": "[patient] ",
        "[patient] I\n[doctor] I\n[patient]\t me \u3000": "[patient] the patient\n[doctor] I\n[patient] the patient",
    }
    assert apply(clean.rewrite_patient, *cases) == list(cases.values())


def test_points_and_marks(apply):
    assert apply(clean.spoken_point, "one . two", "a . . b", "a.b", "one . two , three") == ["one point two", "a point . b", "a.b", "one . two , three"]
    assert apply(clean.cut_leading_mark, ". hello", ",x y", "x") == ["hello", " y", "x"]
    assert apply(clean.flatten_lines, "a\nb", "a\r\nb\x0bc\n", "", "\n") == ["a b", "a b c", "", ""]
    assert apply(clean.drop_returns, "a\r\nb\r") == "a\nb"
    assert apply(punctuation.has_marks, "a,b", "a.b") == [True, False]


def test_words_and_chunks(apply):
    assert apply(punctuation.bare_words, "temp 98.6 , ok .", "a:b 3:4 5.", "") == [["temp", "98.6", "ok"], ["ab", "3:4", "5."], []]
    for n, want in ((0, []), (1, [1]), (230, [230]), (231, [230, 6]), (455, [230, 230]), (456, [230, 230, 6])):
        runs = apply(lambda c: punctuation.chunks(punctuation.bare_words(c)), "w " * n)
        assert [len(r) for r in runs] == want
        given = apply(lambda c: punctuation.contributed(punctuation.chunks(punctuation.bare_words(c))), "w " * n)
        assert sum(map(len, given)) == n


def test_python_provider_on_dialogues(spark):
    upper = punctuation.model(lambda: lambda runs: [["." if w == "end" else "0" for w in r] for r in runs])
    two = spark.createDataFrame([("[doctor] the end ,\n[patient] ok .",), (None,)], "d string")
    assert [r.restore_punctuation_dialogue for r in punctuation.restore_punctuation(two, "d", provider=upper).collect()] == ["[doctor] the end.\n[patient] ok", None]
    with pytest.raises(PySparkException, match="several roles"):
        punctuation.restore_punctuation(spark.createDataFrame([("[a] x [b] y",)], "d string"), "d", provider=upper).collect()
    with pytest.raises(ValueError):
        punctuation.restore_dialogue(F.col("d"), provider=upper)



def test_render_and_providers(apply, spark):
    words, labels = F.array(*map(F.lit, "abcde")), F.array(*map(F.lit, ["0", ",", ".", "x", "-"]))
    assert spark.range(1).select(punctuation.render(words, labels).alias("r")).first().r == "a b, c. d e-"
    upper = punctuation.model(lambda: lambda runs: [["." if w == "end" else "0" for w in r] for r in runs])
    assert apply(upper, "the end , is near " + "x " * 300)[:14] == "the end. is ne"
    assert apply(upper, "x " * 400 + "end").count("x") == 400 and apply(upper, None, "") == [None, ""]
    assert apply(lambda c: punctuation.restore_dialogue(c), "[doctor] hi , you ?\n[patient] ok .") == "[doctor] hi you\n[patient] ok"
    assert apply(lambda c: punctuation.restore_dialogue(c, enforce=False), "[doctor] a , b", "[doctor]  a . b") == ["[doctor] a , b", "[doctor] a b"]
    assert providers.get("punctuation", "keep") is punctuation.keep
    with pytest.raises(KeyError):
        providers.get("sentences", "none")
    providers.register("sentences", "lines", lambda: lambda c: F.split(c, "\n"))
    assert apply(lambda c: sentences.split_sentences(c, splitter=providers.get("sentences", "lines")), "a. b\nc") == ["a. b", "c"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[doctor] a ?\n[patient] b ? ?", "[patient] a ?\n[doctor] b ? ?"),
        ("[doctor] a ?\n[patient] b ?", "[doctor] a ?\n[patient] b ?"),
        ("[doctor] a\n[patient] b ?\n[guest] c ?", "[guest] a\n[doctor] b ?\n[doctor] c ?"),
        ("[doctor] a ?\n[doctor] b", "[doctor] a ?\n[doctor] b"),
        (None, None),
    ],
)
def test_roles_on_arrays_and_rows(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, d string")
    assert roles.fix_role(df, "d").first().fixed_role_dialogue == want
    rows = roles.fix_role_rows(parse.rows(df, "d"), "id", "pos").orderBy("pos").collect()
    assert "\n".join(r.fixed_role + r.text for r in rows) == (want or "")


def test_sentences(apply):
    got = apply(sentences.split_sentences, "hello there. How are you? Fine", "Mr. Smith came. ok", "e.g. this one. yes", "wow! ok")
    assert got == [["hello there.", "How are you?", "Fine"], ["Mr. Smith came.", "ok"], ["e.g. this one.", "yes"], ["wow! ok"]]
    assert apply(sentences.meaningful, "[noise] ok then yes", "yes [laughs]", "a b c") == [True, False, True]
    assert apply(lambda c: sentences.split_sentences(c, "#", True), "one two three. no") == ["one two three.", "#no"]
    with pytest.raises(ValueError):
        sentences.split_sentences(F.lit("a"), mark_noisy=True)
    assert apply(sentences.tokens, "It's 3.5, é_1!") == ["It", "'", "s", "3", ".", "5", ",", "é_1", "!"]


def by_words(c):
    return F.size(F.filter(F.split(c, " "), lambda w: w != ""))


def packed(text, most, overlap, compat):
    """A restatement of greedy packing."""
    n = lambda s: len([w for w in s.split(" ") if w])
    every = re.split(r"[.!?\n]", text)
    out, cur, length = [], [], 0
    for s in every:
        if not s.strip():
            continue
        if n(s) > most:
            subs, sub, used = [x.strip() for x in re.split("[,;:]", s) if x.strip()], [], 0
            for x in subs:
                if used + n(x) > most and sub:
                    out.append(" ".join(sub))
                    sub = sub[-overlap:] if overlap else []
                    used = sum(map(n, subs[: len(sub)] if compat else sub))
                sub.append(x)
                used += n(x)
            if sub:
                out.append(" ".join(sub))
        elif length + n(s) > most:
            out.append(" ".join(cur))
            cur = cur[-overlap:] if overlap else []
            length = sum(map(n, every[: len(cur)] if compat else cur))
            cur.append(s)
            length += n(s)
        else:
            cur.append(s)
            length += n(s)
    return out + ([" ".join(cur)] if cur else [])


def test_chunks(apply):
    assert apply(lambda c: chunks.pack(c, 4, count=by_words), "a b. c d. e") == ["a b  c d", " e"]
    assert apply(lambda c: chunks.pack(c, 4, count=by_words), "x y. a b, c d, e f. z") == ["a b c d", "e f", "x y  z"]
    assert apply(lambda c: chunks.pack(c, 4), "", " . \n") == [[], []]


@pytest.mark.parametrize(("overlap", "compat"), [(0, False), (1, False), (2, False), (2, True)])
def test_chunks_equal_a_restatement(apply, overlap, compat):
    rng = random.Random(overlap)
    texts = ["".join(rng.choice(["a ", "b ", "cc ", ". ", ", ", "? ", "\n", "; "]) for _ in range(60)) for _ in range(40)]
    assert apply(lambda c: chunks.pack(c, 6, overlap, by_words, compat), *texts) == [packed(t, 6, overlap, compat) for t in texts]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0]), (1, [0.0, 0.0], [1.0, 1.0])], "i int, a array<float>, b array<float>")
    got = df.select("i", *[vectors.distance(F.col("a"), F.col("b"), m).alias(m) for m in vectors.METRICS]).orderBy("i").collect()
    assert tuple(got[0])[1:] == (1.0, 2.0, 2**0.5, 1.0) and got[1].cosine is None
    with pytest.raises(ValueError, match="cosine"):
        vectors.distance(F.col("a"), F.col("b"), "dot")
    d = spark.createDataFrame([(0, 0.3), (1, 0.1), (2, 0.2)], "i int, distance double")
    assert [r.i for r in vectors.nearest(d, "i").orderBy("rank").collect()] == [1, 2, 0]
    assert [r.i for r in vectors.top(d, "i", 2).collect()] == [1, 2]
    assert [r.i for r in vectors.nearest(d, "i", descending=True).orderBy("rank").collect()] == [0, 2, 1]
    c = vectors.centres(spark.createDataFrame([("k", [1.0, 2.0]), ("k", [3.0, 4.0])], "k string, v array<double>"), "k", "v").first()
    assert c.centre_mean == 2.5 and c.centre == [2.0, 3.0]
    e = spark.createDataFrame([("a b\nc",), ("",), (None,)], "t string").select(vectors.hashed_embedder(16)(F.col("t")).alias("e")).collect()
    assert len(e[0].e) == 2 and abs(sum(x * x for x in e[0].e[1]) - 1) < 1e-9 and e[1].e == [[0.0] * 16] and e[2].e is None
    m = spark.createDataFrame([({"x": [1.0]},)], "m map<string,array<double>>").select(vectors.pick(F.col("m"), "x").alias("a"), vectors.pick(F.col("m"), "y").alias("b")).first()
    assert m.a == [1.0] and m.b is None


def test_mixture_invariants():
    rng = np.random.default_rng(3)
    blobs = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    found = cluster.Mixture(blobs, 3)
    assert np.allclose(found.posterior.sum(1), 1) and all(b >= a - 1e-9 for a, b in zip(found.bounds, found.bounds[1:]))
    own = found.posterior.argmax(1)
    assert all(len(set(own[i : i + 30])) == 1 for i in (0, 30, 60)) and len(set(own)) == 3
    assert cluster.best_size(blobs, 8) == 3
    assert cluster.memberships(np.array([[0.5, 0.5], [0.4, 0.35], [0.9, 0.1]])) == [[0, 1], [], [0]]
    given = cluster.labels(blobs, 2, 0.4, np.array([[0.0, 0], [5, 0], [0, 5]]))
    assert given[0] == [0] and given[40] == [1] and given[70] == [2]


def test_labelled_dialogues_go_out_a_few_at_a_time(spark, monkeypatch):
    """However many rows a batch brings, a worker makes the texts of a few at once and gives them before the next."""
    texts = [f"[doctor] w{i} end. so\n[patient] so, end" for i in range(1000)] + [None, ""]
    df, seen = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string").coalesce(1), []
    upper = punctuation.model(lambda: lambda runs: [["." if w == "end" else "0" for w in r] for r in runs])
    monkeypatch.setattr(type(df), "mapInArrow", lambda frame, run, schema: seen.append((frame, run)))
    punctuation.restore_punctuation(df, "d", provider=upper)
    (frame, run), = seen
    batch = frame.toArrow().combine_chunks().to_batches()[0]
    parts = list(run(iter([batch])))
    assert batch.num_rows == 1002 and max(p.num_rows for p in parts) <= 256
    got = {i: t for p in parts for i, t in zip(p["i"].to_pylist(), p["restore_punctuation_dialogue"].to_pylist())}
    assert [got[i] for i in range(1002)] == [f"[doctor] w{i} end. so\n[patient] so end." for i in range(1000)] + [None, ""]


def test_mixtures_fitted_together_equal_direct_ones(monkeypatch):
    """Products of coordinates give the criterion and the posteriors of the direct form, dead components too."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(m, s, (n, 12)) for m, s, n in ((0, 1, 300), (2, 0.1, 240), (-1, 2, 90))] + [np.full((9, 12), 5.0)])
    few = np.repeat(rng.normal(0, 1, (3, 12)), 7, 0)
    sizes = [1, 2, 3, 5, 8]
    got, less, means = cluster.criteria(x, sizes), cluster.criteria(few, sizes), rng.normal(0, 1, (4, 12))
    one, given = cluster.Mixture(x, 5), cluster.Mixture(x, 4, means)
    monkeypatch.setattr(cluster, "WIDE", range(0))
    assert np.allclose(got, cluster.criteria(x, sizes), rtol=1e-9) and np.allclose(less, cluster.criteria(few, sizes), rtol=1e-6)
    for a, b in ((one, cluster.Mixture(x, 5)), (given, cluster.Mixture(x, 4, means))):
        assert len(a.bounds) == len(b.bounds) and np.allclose(a.posterior, b.posterior, atol=1e-6) and np.allclose(a.means, b.means)
    assert [k for own in cluster.shares(700) for k in own] == list(range(1, 50)) and cluster.shares(2) == [[1]]


def test_closest_centre_by_rounding():
    """A large product of points and centres decides as the differences do, ties included."""
    rng = np.random.default_rng(8)
    x, centre = rng.integers(0, 2, (40000, 6)).astype(float), rng.integers(0, 2, (9, 6)).astype(float)
    assert (cluster._closest(x, centre) == ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)).all()


def test_sizes_of_a_large_group_go_to_several_tasks(spark):
    """No task tries all sizes of a large group, and the labels are those of one that does."""
    rng = np.random.default_rng(6)
    x = np.vstack((rng.normal(0, 0.2, (150, 8)), rng.normal(2, 0.2, (150, 8))))
    rows = [(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, i, [float(i)] * 8) for i in range(3)]
    got = cluster.cluster(spark.createDataFrame(rows, "k int, i int, v array<double>"), "k", "i", "v")
    plan = got._jdf.queryExecution().toString()
    assert "share__" in plan and "MapInPandas" in plan
    by = {(r.k, r.i): r["labels"] for r in got.collect()}
    assert [by[1, i] for i in range(300)] == cluster.labels(x) and all(by[2, i] == [0] for i in range(3)) and len(by) == 303


def test_cluster_guard_and_regroup(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i, [float(i)]) for i in range(11)] + [(2, i, rng.normal(i % 2 * 9, 0.1, 1).tolist()) for i in range(12)]
    got = cluster.cluster(spark.createDataFrame(rows, "k int, i int, v array<double>"), "k", "i", "v")
    by = {(r.k, r.i): r["labels"] for r in got.collect()}
    assert all(by[1, i] == [0] for i in range(11)) and len(by) == 23
    flat = spark.createDataFrame([(1, 1, [0, 1]), (1, 2, []), (1, 3, [1])], "k int, i int, labels array<int>")
    assert sorted(tuple(r) for r in cluster.regroup(flat, "k", "i").collect()) == [(1, 0, 1), (1, 1, 1), (1, 1, 3)]
    assert cluster.unassigned(flat, "k").first().unassigned == 1


def test_conversations_on_both_sides_of_the_guard(spark, tmp_path):
    """Against a restatement: the least BIC of all sizes, memberships over 0.4, equal points alike."""
    sizes = {1: 1, 2: 11, 3: 12, 4: 40}
    rows = [(c, t, "user", None if (c, t) == (4, 3) else "x" * (t * 7 % 5 + (200 if t % 2 else 0))) for c, n in sizes.items() for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = []
    for c, n in sizes.items():
        if n <= 11:
            want += [(c, t, "0") for t in range(n)]
            continue
        x = np.array([[len(text or ""), t] for k, t, _, text in rows if k == c], float)
        fits = [cluster.Mixture(x, k) for k in range(1, min(50, n))]
        best = min(fits, key=lambda m: m.bic)
        want += [(c, t, ",".join(str(k) for k, p in enumerate(best.posterior[t]) if p > 0.4)) for t in range(n)]
    got = catalogue.queries()["cluster_conversations"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({r[2] for r in want if r[0] == 4}) > 1


def test_sections_and_summaries(spark, apply):
    nodes = spark.createDataFrame([(7, [1.0, 1.0, 0.6])], "n int, v array<double>")
    axes = spark.createDataFrame([(0, [1.0, -1.0, 0.2]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "section_pos int, section_vector array<double>")
    got = lambda **k: sorted((r.section_pos, r.nodes) for r in sections.gathered(sections.assign(nodes, axes, "n", "v", **k), ["section_pos"], "n").collect())
    assert got() == [(1, [7]), (2, [7])] and got(compat="ordinal") == [(0, [7]), (1, [7])]
    text = "the cat sat. the cat ran home. dogs bark\nthe cat sat again. nothing else here"
    assert apply(lambda c: sections.summarise(c, min_length=3, max_length=9), text, None, "")[1:] == [None, ""]
    assert 3 <= len(apply(lambda c: sections.summarise(c, min_length=3, max_length=9), text).split()) <= 9
    assert apply(lambda c: sections.summarise(c, model=str.upper), "a") == "A"
    with pytest.raises(ValueError):
        sections.summarise(F.lit("a"), model=type("M", (), {"generate": None})())


def test_tree(spark):
    df = spark.createDataFrame([(1, "a\r\n\nb")], "id int, d string")
    assert [(r.node_index, r.text) for r in tree.nodes(df, "d").collect()] == [(0, "a"), (1, ""), (2, "b")]
    assert len(tree.nodes(df, "d", embed=vectors.hashed_embedder(8)).first().embedding) == 8
    rows = spark.createDataFrame([(0, "a\nb"), (1, "c")], "o int, t string")
    assert rows.agg(tree.joined_text(F.col("o"), F.col("t")).alias("t")).first().t == "a b\n\nc\n\n"
    layers = spark.createDataFrame([(0, [1, 2]), (1, [2])], "layer int, nodes array<int>")
    assert {r.node: r.layer for r in tree.node_layers(layers).collect()} == {1: 0, 2: 1}
    t = spark.createDataFrame([(2, [1, 1]), (1, [])], "node_id int, children array<int>")
    assert [(r.node_id, r.children) for r in tree.node_list(tree.children(t)).collect()] == [(1, []), (2, [1])]
    assert tree.children(t, spark.createDataFrame([(2,)], "node_id int")).count() == 1


def test_csv_and_ontology(spark, tmp_path):
    cell = " [a] hi\r\n[b] \n"
    df = spark.createDataFrame([(1, cell, "x,\"y\"")], "id int, dialogue string, HPI string")
    assert csv.save(df, str(tmp_path / "c"))
    back = csv.read_dataframe(spark, str(tmp_path / "c"), "dialogue", "id").first()
    assert (back.id, back.dialogue, back.HPI) == ("1", cell, "x,\"y\"")
    assert said(csv.read_dataset(spark, str(tmp_path / "c"), "dialogue").first().utterances) == [("[a]", "  hi\r"), ("[b]", " ")]
    with pytest.raises(ValueError, match="missing columns: nope"):
        csv.read_dataframe(spark, str(tmp_path / "c"), "nope")
    assert csv.section_names(df.selectExpr("id", "HPI", "1 as Plan", "2 as text")) == ["plan"]
    (tmp_path / "o.txt").write_text("\nDivision: One\n\nTitle: A\nPoint: x / y:\nPoint*: z\nDivision: Two\nTitle: B\n")
    got = [tuple(r)[1:] for r in ontology.read_ontology(spark, str(tmp_path / "o.txt")).orderBy("seq").collect()]
    assert got == [("One", None, None, False, []), ("One", "A", None, False, []), ("One", "A", "x / y:", False, ["x", "y"]), ("One", "A", "z", True, ["z"]), ("Two", None, None, False, []), ("Two", "B", None, False, [])]


def test_chain_has_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([("[doctor] um hi ?\n[patient] I am I am ok ? ?",)], "d string")
    out = preprocess(df, "d")
    assert not re.search("Exchange|Python|Arrow", out._jdf.queryExecution().executedPlan().toString())
    # "um" goes, and its spaces stay
    assert out.first().fixed_role_dialogue == "[patient]   hi ?\n[doctor]  the patient is ok ? ?" or out.first().fixed_role_dialogue.startswith("[patient]")
    with pytest.raises(ValueError):
        require_columns(df, "x")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"[doctor] a ?\n[patient] I am {i} {i} ? ?") for i in range(20)], "i int, d string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = dialogues.read_dialogues(spark, str(tmp_path / "in"), df.schema)
        assert dialogues.preprocess_stream(stream, "d", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(preprocess(df, "d").collect())


def test_long_dialogues_and_patient_sentences(spark, apply):
    """Thousands of turns: the other role and the counts are computed once, not once a turn."""
    turns = [("doctor" if i % 2 else "patient", f" turn {i} ?" + " ?" * (i % 2 == 0)) for i in range(4_000)]
    said = "\n".join(f"[{r}]{t}" for r, t in turns)
    want = "\n".join(f"[{'patient' if r == 'doctor' else 'doctor'}]{t}" for r, t in turns)
    got = roles.fix_role(spark.createDataFrame([(said,)], "d string"), "d").first().fixed_role_dialogue
    assert got == want
    split = lambda c: clean.rewrite_patient(c, splitter=sentences.split_sentences)
    assert apply(split, "[patient]  I am ok. My\tarm hurts\n[doctor] I am") == "[patient] the patient is ok. his / her\tarm hurts\n[doctor] I am"


def test_annotations_and_default_providers(spark, apply):
    df = spark.createDataFrame([(1, "[doctor] hi , you\n[patient] ok.")], "k long, d string")
    rows = parse.annotated(df, "d", providers.get("language", "tokens")).orderBy("pos").collect()
    assert [r.annotation for r in rows] == [["hi", ",", "you"], ["ok", "."]]
    assert apply(providers.get("summary", "extractive"), "One two three. Four five.") != ""
    assert apply(providers.get("sentences", "pattern"), "A b. C d") == ["A b.", "C d"]
