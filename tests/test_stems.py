from collections import Counter

from docloom.functions.regions import measure, stem

# Written by hand from the examples of the published description.
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic differentli differ vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll is is by by naïve naïve generalizations gener oscillators oscil""".split()


def test_by_hand():
    assert [(w, stem(w)) for w in PAIRS[::2]] == list(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten", "orrery")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]


def test_query(spark):
    import re

    from docloom.functions.text import MARKED, PLAIN, STOP
    from docloom.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    want = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").filter("lang = 'en'").collect():
        words = re.findall("[a-z0-9]+", r.text.lower().translate(str.maketrans(MARKED, PLAIN)))
        want.update(stem(w) for w in words if w not in STOP)
    assert {r.stem: r.n for r in QUERIES["F05_region_stems"](spark, folder).collect()} == want
