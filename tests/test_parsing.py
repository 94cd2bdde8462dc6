import pytest
from pyspark.sql import functions as F

from clearsift import constants as C
from clearsift.functions.text import strip
from clearsift.functions import front_matter
from clearsift.operators import parsing as P


def clauses(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "document_id long, t string")
    rows = P.clause_rows(P.with_clauses(df, "t", **options)).orderBy("position").collect()
    return [(r.code, r.title, r.text) for r in rows]


def test_markdown_clauses(spark):
    body = "intro\n## 4.10.1 First \none\n\n## 4.1.2 Second\r\ntwo\n## 9 not a clause\n"
    assert clauses(spark, body) == [
        ("4.10.1", "First", "one"),
        ("4.1.2", "Second", "two\n## 9 not a clause"),
    ]


def test_no_clause_gives_no_rows(spark):
    assert clauses(spark, "nothing here") == []


def test_title_limit_swallows_the_header(spark):
    body = f"## 1.1.1 {'t' * 201}\na\n## 1.1.2 {'t' * 202}\nb"
    (code, title, text), = clauses(spark, body)
    assert (code, len(title)) == ("1.1.1", 201)
    assert text.startswith("a\n## 1.1.2")


def test_paged_contents_body_and_tail(spark):
    text = (
        "cover\n1.1.1 One\n1.1.2 Two\n1.1.1 One\nlong body 참고자료 inside\n"
        "  1.1.2 Two\nlast body\n참고자료\nbooks"
    )
    assert clauses(spark, text, paged=True) == [
        ("1.1.1", "One", "long body 참고자료 inside"),
        ("1.1.2", "Two", "last body"),
    ]


def test_paged_ties_keep_the_first(spark):
    text = "2.1.1 First\nsame\n2.1.1 Other\nsame\n"
    assert clauses(spark, text, paged=True) == [("2.1.1", "First", "same")]


def test_front_matter(spark):
    files = [
        ("a.md", '---\ntitle: "Quoted: title"\nclearance: 2\ndepartments: [HR, "Dev"]\n---\nbody'),
        ("b.md", "---\r\ntitle: Plain # note\r\nclearance: 1\r\ndepartments:\r\n  - HR\r\n  - Dev\r\n---\r\nbody"),
        ("c.md", "---\ntitle: x\nclearance: 1\ndepartments: []\n---\nb"),
        ("d.md", "no header"),
        ("e.md", "---\ntitle: x\n---\nno clearance"),
        ("f.md", "\n---\ntitle: x\nclearance: 1\n---\nlate"),
        ("g.md", "---\ntitle: x\nclearance: high\n---\nb"),
    ]
    parsed, rejected = P.split_front_matter(spark.createDataFrame(files, "path string, content string"))
    got = {r.path: (r.title, r.required_clearance, r.allowed_departments, r.body) for r in parsed.collect()}
    assert got == {
        "a.md": ("Quoted: title", 2, ["HR", "Dev"], "body"),
        "b.md": ("Plain", 1, ["HR", "Dev"], "body"),
        "c.md": ("x", 1, None, "b"),
    }
    assert {r.path for r in rejected.collect()} == {"d.md", "e.md", "f.md", "g.md"}


def test_unsupported_extension_is_an_error(spark):
    files = spark.createDataFrame([("a.docx", "x")], "path string, content string")
    with pytest.raises(P.ParseError, match="unsupported"):
        P.parse_files(files)


def test_paged_text_needs_given_permissions(spark):
    files = spark.createDataFrame([("a.PDF", "1.1.1 A\nx")], "path string, content string")
    with pytest.raises(P.ParseError, match="permissions"):
        P.parse_files(files)
    given = files.select("*", F.lit("t").alias("title"), F.lit(1).alias("required_clearance"))
    assert P.parse_files(given).head().doc_type == "pdf"


def test_pages_join_in_order(spark):
    pages = spark.createDataFrame(
        [(1, 10, "c"), (1, 2, "b"), (1, 1, "a"), (2, 1, None)],
        "document_id long, page_no int, text string",
    )
    assert dict(P.join_pages(pages).collect()) == {1: "a\nb \nc", 2: ""}


def test_chunks_stay_inside_clauses(spark):
    rows = spark.createDataFrame([("1.1.1", "x" * 1000), ("1.1.2", " "), ("1.1.3", "y")], "code string, text string")
    got = [(r.code, r.ordinal, len(r.text)) for r in P.chunk_rows(rows).orderBy("code", "ordinal").collect()]
    assert got == [("1.1.1", 0, 900), ("1.1.1", 1, 250), ("1.1.3", 0, 1)]


def test_blank_lines_take_linear_time(spark):
    """200,000 blank lines once took minutes."""
    import time

    text = "1.1.1 First\nbody" + "\n" * 200_000 + "1.1.2 Second\n" + " " * 100_000 + "end" + "\n \n" * 50_000
    docs = spark.createDataFrame([(1, text)], "document_id long, text string")
    started = time.perf_counter()
    assert docs.select(F.length(strip("text"))).first()[0] < len(text)
    found = docs.select(F.size(F.regexp_extract_all("text", F.lit(C.PAGED_CLAUSE), F.lit(0)))).first()[0]
    assert found == 2 and time.perf_counter() - started < 5


HEADS = [
    "title: a\nclearance: 1",
    "title: 'it''s: # no comment'\nclearance: \"2\" # two\ndepartments: ['a, b', \"c\\td\", e f]",
    "title: plain over\n  two lines\n\n  and a third\nclearance: 1",
    "title: \"quoted over\n  two lines \\\n  joined\"\nclearance: 1",
    "title: |\n  literal\n    deeper\n\n  end\nclearance: 1",
    "title: >-\n  folded\n  text\n\n  end\nclearance: 1\ndepartments:\n- HR\n- \"Dev\"",
    "owner:\n  name: x\n  title: not this\n  list:\n    - title: nor this\n      clearance: 9\n    - b\ntitle: right\nclearance: 3",
    "# first\n\ntitle: t  # c\nclearance: 1\ndepartments: [\n  HR,   # one\n  Dev\n]\nextra: {a: 1, b: [x, y], c: 'd'}",
    "title: ~\nclearance:\ndepartments: []",
    "departments:\n  - HR\n  -   Dev # two\n  - 'x y'\ntitle:\n  below\nclearance: 2",
    "title: a#b\nclearance: 1\nurl: http://x/y#z",
    "title: '한글 제목: 하나'\nclearance: 1\ndepartments: [인사, \"개발\"]",
    "title: |+\n  kept\n\nclearance: 1",
    "matrix:\n- - a\n  - b\n- - c\ntitle: t\nclearance: 1",
]


def _as_text(value):
    if isinstance(value, dict):
        return {str(k): _as_text(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_as_text(v) for v in value]
    return None if value is None else str(value)


@pytest.mark.parametrize("head", HEADS)
def test_heads_equal_a_full_reader(head):
    yaml = pytest.importorskip("yaml")
    assert front_matter.read(head) == _as_text(yaml.safe_load(head))
    assert front_matter.read(head.replace("\n", "\r\n")) == _as_text(yaml.safe_load(head))


@pytest.mark.parametrize(
    "head",
    ["", "- a\n- b", "title: a: b\nclearance: 1", "title: 'open\nclearance: 1", "title: a\ntitle: b", "title: &x a",
     "departments: [a, b\ntitle: c", "\ttitle: a", "title: \"\\q\"", "just text", "title: a\n - b: c\n bad"],
)
def test_heads_that_cannot_be_read(head):
    assert front_matter.fields_of(head)[3]


def test_permissions_are_never_guessed(spark):
    files = [
        ("a.md", "---\ntitle: x\nclearance: 1\ndepartments: HR\n---\nb"),
        ("b.md", "---\ntitle: x\nclearance: 1\ndepartments: {HR: 1}\n---\nb"),
        ("c.md", "---\nmeta:\n  title: x\n  clearance: 1\n---\nb"),
        ("d.md", "---\ntitle: x\nclearance: [1]\n---\nb"),
        ("e.md", "---\ntitle: >-\n  of two\n  lines\nclearance: '2'\ndepartments:\n- 'A, B'\n- C # c\n---\nb"),
    ]
    parsed, rejected = P.split_front_matter(spark.createDataFrame(files, "path string, content string"))
    assert [(r.path, r.title, r.required_clearance, r.allowed_departments) for r in parsed.collect()] == [
        ("e.md", "of two lines", 2, ["A, B", "C"])
    ]
    assert rejected.count() == 4
