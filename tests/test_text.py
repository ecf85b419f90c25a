import random
import re

import pytest
from pyspark.sql import functions as F

from vacantia.functions import text

ALPHABET = "aé Z.!?-_/\n\t  \x1cß1½+日,"


def random_texts(n=400, seed=5):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    for _ in range(80):
        sentences = []
        for _ in range(rng.randint(0, 30)):
            sentences.append("w" * rng.choice([3, 20, 38, 39, 40, 41, 120, 300, 419, 420, 421, 900]) + rng.choice(".!?"))
        texts.append(" ".join(sentences))
    return texts


def apply(frame, texts, expression):
    rows = frame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expression(F.col("t")).alias("r"))
    return [r["r"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def loop_sentences(t):
    flat = " ".join(t.split())
    return [s for s in re.split(r"(?<=[.!?])\s+", flat) if s]


def loop_chunks(t):
    merged, short = [], []
    for s in loop_sentences(t):
        if len(s) < 40:
            short.append(s)
            continue
        if short:
            merged.append(" ".join(short))
        short = []
        merged.append(s)
    if short:
        tail = " ".join(short)
        merged[-1:] = [merged[-1] + " " + tail] if merged else [tail]
    chunks, current = [], []
    for s in merged:
        if len(" ".join([*current, s])) <= 420 or not current:
            current.append(s)
        else:
            chunks.append(" ".join(current))
            current = [current[-1], s]
    if current:
        chunks.append(" ".join(current))
    return [c for c in chunks if len(c) >= 40]


def test_scalar_functions_equal_python(frame):
    texts = random_texts()
    cases = {
        "clean": (text.clean_text, lambda t: " ".join(t.split()) or None),
        "trim": (text.trim_text, lambda t: t.strip() or None),
        "describe": (
            text.clean_description,
            lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s\-./]", " ", t.lower())).strip(),
        ),
        "sentences": (text.sentences, loop_sentences),
        "words": (lambda c: F.array_sort(text.word_set(c)), lambda t: sorted(set(re.findall(r"\b\w+\b", t.lower())))),
        "chunks": (text.chunk_text, loop_chunks),
        "answers": (
            text.answer_sentences,
            lambda t: [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", t.strip()) if p.strip()],
        ),
        "terms": (
            lambda c: text.term_list(c, ["stop"]),
            lambda t: [w for w in re.findall(r"\b[a-zA-Z][a-zA-Z\-\+\.]+\b", t.lower()) if len(w) > 2],
        ),
    }
    for name, (ours, python) in cases.items():
        assert apply(frame, texts, ours) == [python(t) for t in texts], name


def test_long_text_with_many_chunks(frame):
    long = " ".join("x" * 200 + "." for _ in range(3000))
    assert apply(frame, [long], text.chunk_text)[0] == loop_chunks(long)


def test_null_texts(frame):
    for expression in (text.clean_text, text.trim_text, text.city_of):
        assert apply(frame, [None], expression) == [None]
    assert apply(frame, [None], text.clean_description) == [""]
    assert apply(frame, [None, "", "   "], text.chunk_text) == [[], [], []]
    assert apply(frame, [None, ""], text.detect_skills) == [[], []]


def test_title_case_and_city(frame):
    names = ["st. john's NEW-york", "Berlin, Germany", "MÜNCHEN , Bayern", " , x", "o'neill 3rd"]
    assert apply(frame, names, text.title_case) == [n.title() for n in names]
    assert apply(frame, names, text.city_of)[1:4] == ["Berlin", "München", None]


def test_seniority_label(frame):
    given = ["junior", "SENIOR", "Mid", " sr ", "principal", "entry level", "", None]
    assert apply(frame, given, text.seniority_label) == [
        "Junior", "Senior", "Mid", "Senior", "Principal", "Entry Level", None, None,
    ]


@pytest.mark.parametrize(
    "level,title,description,expected",
    [
        (None, "Internal Auditor", None, "Intern"),
        (None, "Leadership Coach", None, "Lead"),
        ("Mid-Senior level", "Engineer", None, "Senior"),
        (None, "Sr. Developer", None, "Senior"),
        (None, "Srx Developer", None, None),
        (None, "Staff", None, "Staff"),
        (None, "Staffing Agent", None, None),
        ("", " ", "We want a junior person", "Junior"),
        ("", "Cook", "We want a junior person", None),
        (None, None, "x" * 400 + " junior", None),
        (None, None, None, None),
    ],
)
def test_seniority_rules(frame, level, title, description, expected):
    rows = frame([(level, title, description)], "l string, t string, d string")
    got = rows.select(text.seniority_from_text(F.col("l"), F.col("t"), F.col("d"))).first()[0]
    assert got == expected


def test_categories_and_word_mode(frame):
    titles = ["Senior ML Engineer", "ETL Developer", "SRE", "Therapist", None, "AI/ML Engineer"]
    assert apply(frame, titles, text.category_from_title) == [
        "machine learning", "data engineering", "software engineering", "other", "other", "machine learning",
    ]
    assert apply(frame, ["Therapist", "Nurse"], text.is_tech_title) == [True, False]
    assert apply(frame, ["Therapist", "API Nurse"], lambda c: text.is_tech_title(c, whole_words=True)) == [False, True]


def test_skills(frame):
    texts = [
        "Python, FastAPI and PostgreSQL with Docker and APIs",
        "postgres sklearn amazon web services",
        "javascript only, node.js, ci/cd. c++",
        "goa gopher go",
        "éjava java_x t-sql",
        "",
    ]
    assert apply(frame, texts, text.detect_skills) == [
        ["api", "docker", "fastapi", "postgresql", "python"],
        ["aws", "postgresql", "scikit-learn"],
        ["ci-cd", "javascript", "nodejs"],
        ["golang"],
        ["sql"],
        [],
    ]


def test_skills_equal_one_pattern_per_skill(frame):
    from vacantia.functions import rules

    rng = random.Random(3)
    phrases = [p for ps in rules.SKILL_LEXICON.values() for p in ps]
    texts = [" ".join(rng.choice(["", "x", "-", "é", "_", "/"]) + rng.choice(phrases) + rng.choice(["", "s", ".", "ü", " "])
                      for _ in range(12)) for _ in range(300)]

    def loop(t):
        return sorted(s for s, ps in rules.SKILL_LEXICON.items() if any(re.search(rf"\b{re.escape(p)}\b", t.lower()) for p in ps))

    assert apply(frame, texts, text.detect_skills) == [loop(t) for t in texts]


def test_dates(frame):
    given = ["1713397508000.0", "1713397508000", "2024-02-29T23:30:00-05:00", "2024-01-15 12:30:00", "2023-11-05",
             "03/09/2024", "Mar 9, 2024", "soon", "", None, "1e30", "NaN"]
    listed = [str(d) if d else None for d in apply(frame, given, text.listed_date)]
    assert listed == ["2024-04-17", "2024-04-17", "2024-03-01", "2024-01-15", "2023-11-05", "2024-03-09", "2024-03-09"] + [None] * 5
    assert str(apply(frame, given[2:3], text.parse_date)[0]) == "2024-02-29"


def test_question_types(frame):
    asked = ["Which jobs use Python?", "What skills are common?", "Tell me what jobs exist", "How is pay?", "common requirements"]
    assert apply(frame, asked, text.question_type) == ["jobs", "skills", "jobs", "general", "skills"]


def test_phrases_are_found_by_their_words_and_only_as_a_whole(frame):
    lexicon = {"ab": ["a/b", "a b"], "c++": ["c++"], "net": [".net core", "ré sumé"], "x": ["x_y z", "one"]}
    texts = ["a/b", "A B.", "b a", "a  b", "aa/b", "c++", "c ++", "objc++", "asp .net core", "net core", "ré sumé", "résumé", "x_y z one", "x y z", "zone", ""]
    assert apply(frame, texts, lambda t: text.detect_skills(t, lexicon)) == [
        ["ab"], ["ab"], [], [], [], ["c++"], [], [], ["net"], [], ["net"], [], ["x"], [], [], []]


def test_texts_are_not_searched_for_every_phrase(frame):
    """A text is searched for a phrase only if it has all its words."""
    held = frame([("x",)], "t string").select(text.detect_skills(F.col("t"), {"ab": ["a b"], "one": ["one"]}))
    plan = held._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.index("array_contains(lambda") < plan.index("contains(lambda", plan.index("array_contains(lambda") + 20)
