from docloom.operators import outline
from docloom.operators.outline import outline_chunks

TEXT = """intro line
# One
first
## One A
body of a
###### Deep
x
# Two
## Two A
y

def run(x):
    return x

async def more():
    return 1
"""


def test_outline(spark):
    docs = spark.createDataFrame([(1, TEXT, "p"), (2, None, "p"), (3, " \n\n", "p"), (4, "no headings", "p")], "doc long, text string, path string")
    rows = outline_chunks(docs, "doc", "text", target=1000, least=1).orderBy("id", "seq").collect()
    mine = [(r.path, r.symbol, r.start, r.end) for r in rows if r.id == 1]
    assert mine == [
        ("", None, 1, 1),
        ("One", None, 2, 3),
        ("One > One A", None, 4, 5),
        ("One > One A > Deep", None, 6, 7),
        ("Two", None, 8, 8),
        ("Two > Two A", None, 9, 11),
        ("Two > Two A", "run", 12, 14),
        ("Two > Two A", "more", 15, 17),
    ]
    assert [(r.id, r.text) for r in rows if r.id != 1] == [(4, "no headings")] and rows[6].importance > 0


def test_sizes(spark):
    """Long sections are cut between lines, small ones joined, the ends and the
    most important of the rest stay."""
    long = "\n".join(f"line {i:03d} of some length" for i in range(100))
    docs = spark.createDataFrame([(1, f"# A\n{long}\n# B\nb\n# C\nc\n# D\nd")], "doc long, text string")
    rows = outline_chunks(docs, "doc", "text", target=500, least=12).orderBy("seq").collect()
    assert all(len(r.text) <= 500 + 30 for r in rows) and "\n".join(r.text for r in rows).replace("\n\n", "\n") == f"# A\n{long}\n# B\nb\n# C\nc\n# D\nd"
    assert [r.text for r in rows[-2:]] == ["# B\nb\n\n# C\nc\n\n# D\nd"][-2:] or rows[-1].text.endswith("d")
    few = outline_chunks(docs, "doc", "text", target=500, least=12, most=3).orderBy("seq").collect()
    assert [r.seq for r in few] == [0, 1, 2] and few[0].text == rows[0].text and few[-1].text == rows[-1].text
    inner = max(rows[1:-1], key=lambda r: (r.importance, -r.start))
    assert few[1].text == inner.text


def test_tasks_follow_the_text(spark, monkeypatch):
    """A task gets a bounded part of the text, in the only shuffle, and the chunks
    are the same in any number of tasks."""
    docs = spark.createDataFrame([(i, f"# A{i}\n" + "line of text\n" * 20) for i in range(40)], "doc long, text string")
    want = sorted(map(tuple, outline.outline_chunks(docs, "doc", "text", 100, 20, 5).collect()))
    monkeypatch.setattr(outline, "TASK", 500)
    out = outline.outline_chunks(docs, "doc", "text", 100, 20, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 == plan.count("Exchange ") and "REPARTITION_BY_NUM" in plan
    size = sum(len(r.text) for r in docs.collect())
    assert f", {-(-size // 500)})" in plan
    assert sorted(map(tuple, out.collect())) == want
