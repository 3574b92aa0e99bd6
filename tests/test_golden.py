"""Hand-made rows with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.functions.register import register_functions
from scholia.operators import extraction as ex
from scholia.operators import graph as g
from scholia.operators import learner as l
from scholia.operators import local_terms as lt
from scholia.operators import ordering, structure, study, writes
from scholia.operators import recommend as r
from scholia.operators import text as x
from scholia.sources import files


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("word,stem", [("cats", "cat"), ("ponies", "poni"), ("grass", "grass"), ("jumped", "jump"),
                                       ("running", "run"), ("cat", "cat"), ("agreed", "agre"), ("seed", "seed"),
                                       ("relational", "relat"), ("electrical", "electr"), ("happy", "happi")])
def test_stem(spark, word, stem):
    assert one(spark.range(1).select(tx.stem(F.lit(word))))[0] == stem


def test_sql_functions_agree_with_columns(spark):
    register_functions(spark)
    words = ["relational", "running", "don't", "classes", "happily", "hopefulness", "a", "controlling"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select(F.expr("study_stem(w)").alias("s"), tx.stem("w").alias("t"),
                    F.expr("study_syllables(w)").alias("a"), tx.syllables("w").alias("b")).collect()
    assert all(row.s == row.t and row.a == row.b for row in got)
    assert one(spark.sql("SELECT study_tokens('The Cat, a 2-way é x') t")).t == ["the", "cat", "2-way"]
    assert one(spark.sql("SELECT study_material_type('final exam.pdf', '') t")).t == "Past Paper"


def test_sentences(docs):
    text = "Dr. Smith arrived late today. The value is 3.14 exactly here. Too short. See $a.b$ in e.g. Figure twelve now!"
    got = [s.sentence for s in x.sentences(docs(text)).collect()]
    assert got == ["Dr. Smith arrived late today.", "The value is 3.14 exactly here.", "See $a.b$ in eg. Figure twelve now!"]


def test_empty_and_null_text(docs):
    assert x.sentences(docs("", "   ")).count() == 0
    assert x.tokens(docs("")).count() == 0


def test_readability_and_language(docs):
    text = "The cat sat on the mat and the dog was in the garden with a ball. It is for the cat and the dog to play."
    row = one(x.language_id(docs(text)))
    assert row.language == "English" and not row.is_multilingual
    assert one(x.language_id(docs("short"))).language == "Unknown"
    assert one(x.readability(docs(text))).sentences == 2


def test_script_beats_profile(docs):
    text = "ab cd " + "数据分析" * 10
    assert one(x.language_id(docs(text))).language == "Chinese/Japanese/Korean"


def test_keywords_prefer_repeated_phrases(docs):
    text = "Gradient descent works. Gradient descent converges quickly on convex problems. Momentum helps momentum."
    got = [k.keyword for k in x.keywords(docs(text), 4).orderBy("rank").collect()]
    assert got[0] == "gradient descent" and "momentum" in got and "gradient" not in got


def test_clean_ocr(docs):
    text = "Page 3\nThe comp-\nuter works.It is fine\nRepeated header line\nRepeated header line\n 12 \nend of th e text"
    row = one(x.clean_ocr(docs(text)))
    assert "computer works. It is fine" in row.cleaned
    assert row.cleaned.count("Repeated header line") == 1
    assert "the text" in row.cleaned
    assert one(x.clean_ocr(docs("this is a test"), True)).cleaned == "this isa test"


def test_chunks_cover_text(docs):
    text = "abcdefghij" * 50
    rows = x.fixed_chunks(docs(text), 100, 10, 16).orderBy("chunk").collect()
    joined = rows[0].body + "".join(c.body[10:] for c in rows[1:])
    assert joined == text and rows[0].coverage_pct == 100


def test_sections(docs):
    text = "# Intro\nhello\n\n1.2 Methods used\nbody\nCHAPTER 2: Results\nmore\nMAIN RESULTS\nlast"
    rows = structure.sections(docs(text)).orderBy("section").collect()
    assert [(s.title, s.level, s.parent_section) for s in rows] == [
        ("Intro", 1, None), ("Methods used", 2, 1), ("Results", 1, None), ("MAIN RESULTS", 2, 3)]
    assert rows[0].content == "hello"
    count = docs(text).select(structure.root_section_count("text").alias("n"))
    assert one(count).n == 2


def test_implicit_introduction(docs):
    rows = structure.sections(docs("a\nb\nc\nd\ne\nf\n# Next\nz")).orderBy("section").collect()
    assert [(s.title, s.level) for s in rows] == [("Introduction", 0), ("Next", 1)]
    assert [s.title for s in structure.sections(docs("a\nb\n# Next\nz")).collect()] == ["Next"]


def test_pipe_table(docs):
    text = "Caption here\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\nafter"
    cells = {(c.row, c.col): c.value for c in structure.text_tables(docs(text)).collect()}
    assert cells == {(0, 0): "a", (0, 1): "b", (1, 0): "1", (1, 1): "2", (2, 0): "3", (2, 1): "4"}
    assert one(structure.text_tables(docs(text))).caption == "Caption here"


def test_captioned_table(docs):
    text = "Table 1: Marks\nname | mark\nann | 7\n\nend"
    row = one(structure.text_tables(docs(text)))
    assert row.title == "Marks" and row.kind == "captioned"


def test_figures(docs):
    text = "As Figure 2 shows, all is well.\nFigure 2: A flowchart of steps\nSee fig. 2 again. [Image: A cat]"
    rows = {f.number: f for f in structure.figures(docs(text)).collect()}
    assert rows["2"].type == "chart" and len(rows["2"].mentions) == 2
    assert rows[None].caption == "A cat"


def test_references(docs):
    text = ("See (Miller, 2019) and (Chen et al., 2020) at https://a.org/x\n\nReferences\n"
            "Smith, J. A. (2020). Deep things. Journal of Things.\n[1] Brown, A, Some work. A long title. 1999\n")
    rows = ex.references(docs(text)).collect()
    styles = {(s.style, s.year) for s in rows}
    assert {("apa", 2020), ("inline", 2019), ("inline", 2020), ("url", None), ("numeric", 1999)} <= styles
    apa = [s for s in rows if s.style == "apa"][0]
    assert apa.title == "Deep things" and apa.source == "Journal of Things"
    counts = ex.citation_counts(ex.references(docs(text))).collect()
    assert any(c.author == "miller" and c.citations == 1 for c in counts)


def test_entities(docs):
    text = ("Dr. Ada Lovelace met Charles Babbage in London. Newton's Law is known. The Theory of Relativity came in 1905. "
            "Water is H2O. Oxford University taught Machine Learning; later Machine Learning grew by 25 kg.")
    found = {(e.type, e.key): e.frequency for e in ex.entities(docs(text)).collect()}
    assert found[("person", "ada lovelace")] == 2
    assert found[("law", "newton's law")] == 1 and found[("law", "theory of relativity")] == 1
    assert found[("chemical", "h2o")] == 1 and found[("date", "1905")] == 1
    assert found[("concept", "machine learning")] == 1 and found[("number", "25 kg")] == 1
    assert ("organization", "oxford university") in found


def test_definitions(docs):
    text = ("Photosynthesis is the process by which plants turn light into energy. It is a thing that happens every day in plants. "
            "Osmosis refers to the movement of water across a membrane in cells.")
    got = [(d.term, d.definition[:12]) for d in ex.definitions(docs(text)).orderBy("sent_idx").collect()]
    assert got == [("Photosynthesis", "the process "), ("Osmosis", "the movement")]


def test_formulas(docs):
    text = "Einstein wrote $E = mc^2$ where E is energy and m is mass. Then $$x_1 + y_2$$ came."
    rows = {f.raw: f for f in ex.formulas(docs(text)).collect()}
    assert {"E = mc^2", "x_1 + y_2"} <= set(rows)
    assert rows["E = mc^2"].description == "E is energy and m is mass"
    assert rows["x_1 + y_2"].variables == ["x_1", "y_2"]


def test_causes_and_reasoning(docs):
    text = ("Smoking causes serious lung disease. Heavy rain leads to severe local flooding. "
            "If the pressure rises, then the valve opens at once. Therefore the tank stays intact.")
    causes = {(c.cause, c.effect, c.strength) for c in ex.causal_relations(docs(text)).collect()}
    assert ("Smoking", "serious lung disease", "strong") in causes
    steps = {(s.type, s.premise, s.conclusion) for s in ex.reasoning_steps(docs(text)).collect()}
    assert ("conditional", "the pressure rises", "the valve opens at once") in steps
    assert ("deductive", "implicit", "the tank stays intact") in steps


def test_inferences(docs):
    text = "The match was stopped early because the rain fell heavily."
    row = one(ex.inferences(docs(text)))
    assert row.rule == "Causal Inference" and row.conclusion == "The match was stopped early"
    assert row.premises == ["the rain fell heavily."]


def test_prerequisites_and_codes(docs):
    text = "We start by assuming knowledge of linear algebra. Prerequisites: ECO 301 and MATH101 come first in this course.\n"
    got = [p.prerequisite for p in ex.prerequisites(docs(text)).orderBy("rank").collect()]
    assert got[0] == "linear algebra"
    codes = {c.code: c.mentions for c in ex.course_codes(docs(text)).collect()}
    assert codes == {"ECO 301": 1, "MATH101": 1}


def test_answers(spark, docs):
    text = "Smoking causes serious lung disease. Plants convert sunlight into chemical energy daily."
    ask = spark.createDataFrame([(1, 1, "Why is smoking bad?"), (2, 1, "What converts sunlight energy?"), (3, 1, "Who?")],
                                "question_id long, doc_id long, question string")
    got = {a.question_id: a for a in ex.answers(ask, docs(text)).collect()}
    assert got[1].answer == "Smoking causes serious lung disease" and got[1].confidence == 0.8
    assert got[2].answer.startswith("Plants convert") and got[3].answer == ex.NO_ANSWER


def test_local_terms(docs):
    row = one(lt.normalise_local_terms(docs("Sir said the colour of kwacha in ECO301 notes")))
    assert row.text == "The lecturer said the color of kwacha in ECO301 notes"
    assert {e.original for e in row.expansions} == {"Sir said", "colour", "kwacha"}
    assert row.course_codes == ["ECO301"]


def test_file_kinds(spark):
    rows = [("a.pdf", None, b"xx"), ("a", "image/png", b"xx"), ("a", None, bytes.fromhex("25504446")),
            ("a", None, bytes.fromhex("504B0304")), ("a.doc", "application/pdf", b""), ("a", None, b"zz")]
    df = spark.createDataFrame(rows, "path string, mime string, content binary")
    assert [f.kind for f in files.file_kind(df).collect()] == ["pdf", "image", "pdf", "office", "pdf", "none"]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello  world\r\n\r\n\r\n\r\nbye" + " word" * 60)
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    row = one(files.read_text_corpus(spark, str(tmp_path)))
    assert row.text.startswith("hello world\n\nbye") and row.quality == "good" and row.confidence == 0.92
    table = tmp_path / "t.csv"
    table.write_text('a,b\n"x,y",2,3\nz\n')
    got = [tuple(c) for c in files.read_delimited(spark, str(table)).collect()]
    assert got == [("a", "b", ""), ("x,y", "2", "3"), ("z", "", "")]


TEXT = ("Photosynthesis is the process by which green plants turn light into chemical energy. "
        "Chlorophyll absorbs red light and blue light during photosynthesis in green plants. "
        "First, chlorophyll absorbs light inside the leaf of the plant. Then the plant splits water molecules into oxygen. "
        "The Calvin Cycle fixes carbon dioxide into sugar inside the chloroplast of plants. "
        "The Calvin Cycle requires energy from light reactions of the green plants. "
        "Oxygen leaves the leaf through small pores called stomata during the day. "
        "Sugar feeds the plant and stores chemical energy for later growth of leaves.")


def test_textrank_is_a_distribution(docs):
    ranks = [r_.rank for r_ in study.textrank(docs(TEXT)).collect()]
    assert len(ranks) == 8 and math.isclose(sum(ranks), 1.0, abs_tol=1e-3) and min(ranks) > 0


def test_power_iteration_matches_dense_matrix():
    import numpy as np

    sents = [["a", "b"], ["b", "c", "c"], ["a", "c"], []]
    words = sorted({w for s in sents for w in s})
    m = np.array([[s.count(w) for w in words] for s in sents], float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sim = unit @ unit.T
    np.fill_diagonal(sim, 0)
    sums = sim.sum(axis=1, keepdims=True)
    sim = np.divide(sim, sums, out=sim, where=sums > 0)
    rank = np.full(4, 0.25)
    for _ in range(50):
        new = 0.15 / 4 + 0.85 * sim.T @ rank
        done = np.abs(new - rank).max() < 1e-6
        rank = new
        if done:
            break
    assert np.allclose(study.power_iteration(sents), rank)


def test_summary_keeps_order_and_size(docs):
    text = one(study.summarise(docs(TEXT), 3)).summary
    places = [TEXT.index(s) for s in [p.sentence for p in x.sentences(docs(TEXT)).collect()] if s in text]
    assert len(places) == 3 and places == sorted(places)
    kinds = {k.kind for k in study.key_points(docs(TEXT), 3).collect()}
    assert kinds == {"key_point", "takeaway"}


def test_cards_and_quiz(docs):
    cards = study.flashcards(docs(TEXT)).orderBy("position").collect()
    assert cards[0].question == "What is Photosynthesis?" and cards[0].source == "definition"
    assert [c.position for c in cards] == list(range(len(cards)))
    assert len({c.question.lower() for c in cards}) == len(cards)
    assert any(c.source == "cloze" and study.BLANK in c.question for c in cards)
    quiz = study.quiz(docs(TEXT)).orderBy("position").collect()
    assert all(len(q.options) == 4 for q in quiz)
    first = [q for q in quiz if q.type == "mcq"][0]
    assert first.options[first.correct_index].startswith("the process by which")


def test_shuffle_is_a_permutation():
    for seed in range(12):
        assert sorted(study.shuffle_order(seed)) == [0, 1, 2, 3]
    assert study.shuffle_order(0) == study.shuffle_order(0)


def test_concept_nodes_of_long_texts(docs):
    text = " ".join(f"The solar panel{chr(97 + i % 26)}{chr(97 + i // 26)} was with them." for i in range(40))
    labels = lambda **limit: {n.label for n in g.concept_nodes(docs(text), with_definitions=False, **limit).collect()}
    late = {x for x in labels() if x.startswith("solar panel")}
    assert "solar panelnb" in late and len(late) == 40
    assert {x for x in labels(phrases=20) if x.startswith("solar panel") and " " in x} < late


def test_concept_graph(docs):
    nodes = g.concept_nodes(docs(TEXT))
    assert {"photosynthesis"} <= {n.label for n in nodes.collect()}
    edges = g.concept_edges(docs(TEXT), nodes)
    pairs = [tuple(sorted((e.source, e.target))) for e in edges.collect()]
    assert pairs and len(set(pairs)) == len(pairs)
    path = study.study_path(docs(TEXT)).orderBy("position").collect()
    assert [p.type for p in path][-3:] == ["practice", "test", "explore"]


def test_edge_relations(spark, docs):
    d = docs("A dog is a type of animal. Smoke leads to fire here. The car depends on fuel.")
    edges = spark.createDataFrame([(1, 0, 1, "dog", "animal"), (1, 2, 3, "fire", "smoke"), (1, 4, 5, "car", "fuel"), (1, 6, 7, "x", "y")],
                                  "doc_id long, source int, target int, source_label string, target_label string")
    got = {e.source: e.relation for e in g.edge_relations(edges, d).collect()}
    assert got == {0: "is_a", 2: "caused_by", 4: "depends_on", 6: "related_to"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45)] + [(100, k) for k in range(101, 120)]
    got = {c.node: c.component for c in g.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 31)} == {1} and got[50] == got[45] == 40 and got[119] == 100


def test_similar_items_with_copies(spark):
    texts = ["alpha beta gamma delta"] * 5 + ["alpha beta gamma omega", "zeta eta theta", "zeta eta iota"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for row in r.similar_materials(x.tfidf(df), k=3, min_score=0.1).collect():
        got.setdefault(row.id, []).append((row.rank, row.other_id))
    assert [o for _, o in sorted(got[0])] == [1, 2, 3] and [o for _, o in sorted(got[4])] == [0, 1, 2]
    assert [o for _, o in sorted(got[5])] == [0, 1, 2] and [o for _, o in sorted(got[6])] == [7]


def test_similar_pairs_equal_brute_force(spark):
    import itertools
    import random

    random.seed(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(random.choices(words, [1 / (i + 1) for i in range(40)], k=25)) for _ in range(60)]
    vectors = r.unit_vectors(x.tfidf(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    by_doc = {}
    for v in vectors.collect():
        by_doc.setdefault(v.doc_id, {})[v.stem] = v.u
    for bound in (0.3, 0.6, 0.8):
        want = {
            (a, b) for a, b in itertools.combinations(sorted(by_doc), 2)
            if sum(u * by_doc[b].get(k, 0) for k, u in by_doc[a].items()) >= bound
        }
        assert {(p.a, p.b) for p in r.similar_pairs(vectors, bound).collect()} == want


def test_positions_number_every_row(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), (5000 - F.col("id")).alias("v"))
    rows = ordering.positions(df, ["k"], [F.col("v")], "p").collect()
    for key in (0, 1):
        mine = sorted((q.v, q.p) for q in rows if q.k == key)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, name string, note string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", None)], "id int, name string, note string")
    once = writes.upsert_by_key(base, new, ["id"], ["name"])
    twice = writes.upsert_by_key(once, new, ["id"], ["name"])
    want = {(1, "a", "x"), (2, "b", "n"), (3, "c", None)}
    assert {tuple(q) for q in once.collect()} == want == {tuple(q) for q in twice.collect()}


def test_mastery_does_not_depend_on_slices(spark):
    rows = [(i, i % 3, f"2024-01-{1 + i % 28:02d} 0{i % 9}:00:00", f"t{i % 2}", (i * 37 % 100) / 100, "quiz" if i % 4 else "card")
            for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, topic string, ratio double, kind string").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    keep = lambda d: sorted((q.user_id, q.topic, round(q.level, 9), q.trend, q.attempts) for q in d.collect())
    assert keep(l.topic_mastery(df, "2024-02-01", 3600)) == keep(l.topic_mastery(df, "2024-02-01", 10**9))


def test_swap_and_merge_summaries(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "p int, position int, v string")
    assert {(q.v, q.position) for q in writes.swap_positions(rows, "p", 1, 0, 1).collect()} == {("a", 1), ("b", 0)}
    parts = spark.createDataFrame(
        [(1, 0, "This first piece is long enough. And so is this second one"), (1, 1, "A third piece that is long enough")],
        "doc_id int, chunk int, summary string")
    got = one(writes.merge_summaries(parts, 2)).summary
    assert got == "This first piece is long enough. And so is this second one"


def test_formulas_of_a_long_text(docs):
    """Each formula once, with the sentence that holds it, also among many; case and blanks don't count."""
    n = 300
    text = " ".join(f"Here $a_{i} = b + {i}$ follows in turn." for i in range(n)) + " Again $A_7 = B + 7$ is named here."
    rows = ex.formulas(docs(text)).orderBy("position").collect()
    assert [r.raw for r in rows] == [f"a_{i} = b + {i}" for i in range(n)]
    assert all(r.context == f"Here $a_{i} = b + {i}$ follows in turn." for i, r in enumerate(rows))


def test_formulas_of_odd_texts(docs):
    assert ex.formulas(docs("", None, "no sign at all here")).count() == 0
