"""Each operator on a small table with nulls, empty texts, repeated rows and a
clashing extra column, against brute force; and on an empty table."""

import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, copies int, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


ROWS = (
    [(i, text(i, 20 + 7 * i), "en", f"s{i % 3}") for i in range(40)]
    + [(100, None, None, None), (101, "", "en", "s0"), (102, " \n", "en", None), (103, "É <|endoftext|> naïve 東京 it's", "fr", "s1"), (None, "no id at all", "en", "s2")]
    + [(200 + i, text(7, 69), "en", "s0") for i in range(6)]
    + [(300, text(9, 83) + " tail", "en", "s1"), (301, text(5, 3000), "en", "s2"), (5, text(5, 55), "en", "s2"), (5, text(5, 55), "en", "s2")]
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + (len(r[1] or ""), -1, "k", -1, -1.0) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int"


def test_sharding(docs, none):
    from docloom.llm.sharding import schedule, shard

    sizes = [7, 7, 5, 3, 3, 1]
    loads, heap = [0] * 2, [(0, 0), (0, 1)]
    for s in sizes:
        load, k = heapq.heappop(heap)
        loads[k] += s
        heapq.heappush(heap, (load + s, k))
    got = [0] * 2
    for s, k in zip(sizes, schedule(sizes, 2), strict=True):
        got[k] += s
    assert sorted(got) == sorted(loads)

    rows = shard(docs, 4).collect()
    assert len(rows) == len(ROWS) and {r.law for r in rows} == {"bytes"}
    texts = {}
    for r in rows:
        texts.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for (_, size), s in texts.items() if size > 8)  # null and empty texts differ
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(x.slot for x in part) == list(range(len(part))) for part in by.values())
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert shard(none).count() == 0


def test_sharding_balances_bytes(spark):
    """Loads against the greedy schedule of all groups on its own: within two
    units (a thousandth of a shard each), or what one large group forces."""
    from docloom.llm.sharding import schedule, shard

    r = np.random.default_rng(9)
    for huge in (0, 300_000):
        texts = ["x" * int(n) + str(i) for i, n in enumerate(r.pareto(1.2, 3000) * 40)] + ["copy" * 50] * 400 + ["y" * huge, None, ""]
        rows = shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 6).collect()
        loads = np.zeros(6)
        for x in rows:
            loads[x.shard] += x.size
        groups = {}
        for t in texts:
            groups[t] = groups.get(t, 0) + len(t or "") + 8
        best = np.zeros(6)
        for n, s in zip(groups.values(), schedule(list(groups.values()), 6), strict=True):
            best[s] += n
        assert loads.sum() == best.sum() and loads.max() <= best.max() + 2 * loads.sum() / 6000 + 2


def test_mixing(docs, none):
    from docloom.llm.mixing import mix

    rows = mix(docs).collect()
    assert len(rows) == len(ROWS)
    size = {}
    for _, t, _, s in ROWS:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / w for s in order}
        more = {s for s in order if target[s] >= 3 * size[s]} - full
        if not more or len(full | more) == len(order):
            break
        full |= more
    found = {round(r.target, 6) for r in rows}
    assert found == {round(x, 6) for x in target.values()}
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.target] = taken.get(r.target, 0) + r.taken
    assert all(abs(n - t) <= max(60, 0.05 * t) for t, n in taken.items())
    again = {(r.doc_id, r.size, r.taken) for r in mix(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in rows}
    assert mix(none).count() == 0


def test_fingerprint(spark, docs, none):
    """Order, edited texts, sketches and likeness by brute force, with null and
    shared ids, repeated rows, one range and many."""
    import xxhash

    from docloom.llm.fingerprint import fingerprint

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))
    hashes = lambda t: F.transform(t, lambda x: F.xxhash64(x))

    def sketches(texts):
        """Bottom 128 of the hashes of runs of five hashed words."""
        runs = []
        for t in texts:
            w = [x for x in re.split(r"\s+", t.lower()) if x]
            runs += [w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else []
        hashed = spark.createDataFrame([(" ".join(x), x) for x in runs], "run string, words array<string>").distinct().withColumn("words", hashes("words"))
        by = {r.run: r.h for r in hashed.select("run", F.xxhash64(*[F.get("words", i) for i in range(5)]).alias("h")).collect()}
        out = {}
        for t in texts:
            w = [x for x in re.split(r"\s+", t.lower()) if x]
            out[t] = sorted({by[" ".join(w[i : i + 5])] for i in range(max(1, len(w) - 4))} if w else set())[:128]
        return out

    def alike(a, b):
        both = sorted({*a, *b})[:128]
        return len({*both} & {*a} & {*b}) / len(both) if both else 1.0

    more = [(None, f"no id {i} " + text(i, 30)) for i in range(40)] + [(None, "same, no id")] * 3 + [(77, text(i, 9)) for i in range(25)]
    given = [(d, t) for d, t, *_ in ROWS] + more
    order = sorted(((d is not None, d or 0, of(t or ""), d, t or "") for d, t in given), reverse=True)
    edited, want = [], []
    for i, (*_, d, t) in enumerate(order):
        n = order[(i + 1) % len(order)][-1]
        half = len(t) // 2
        edited.append((d, t, t[: len(t) - half] + n[:half], n))
    known = sketches({x for _, t, e, n in edited for x in (t, e, n)})
    code = lambda s: "".join(f"{x % (1 << 64):016X}" for x in s)
    for d, t, e, n in edited:
        want.append((-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest(), code(known[t]), code(known[e]), round(alike(known[t], known[e]), 9), round(alike(known[t], known[n]), 9)))
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("rank", F.lit(2)).repartition(5)
    for size in (1, 2000, 1 << 30):
        rows = fingerprint(df, bucket_bytes=size).collect()
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
        assert sorted(got) == sorted(want)
    assert fingerprint(none).count() == 0
    assert [(r.near_next, r.n_chars) for r in fingerprint(spark.createDataFrame([(1, "one text alone")], "doc_id long, text string")).collect()] == [(1.0, 14)]


def test_sketch_estimates(spark):
    from docloom.llm.fingerprint import containment, distinct_shingles, merge, resemblance, sketch

    a = [f"w{i}" for i in range(3000)]
    x, y = " ".join(a[:2000]), " ".join(a[1000:])
    df = spark.createDataFrame([(x, y)], "x string, y string").select(sketch(F.col("x")).alias("x"), sketch(F.col("y")).alias("y"), sketch(F.concat_ws(" ", "x", "y")).alias("both"))
    r = df.select(resemblance(F.col("x"), F.col("y")).alias("j"), containment(F.col("x"), F.col("y")).alias("c"), distinct_shingles(F.col("x")).alias("n"), F.size(F.array_intersect(merge(F.col("x"), F.col("y")), F.col("both"))).alias("m")).first()
    assert abs(r.j - 1 / 3) < 0.15 and abs(r.c - 0.5) < 0.2 and abs(r.n - 1996) < 500 and r.m >= 124


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    from docloom.llm.token_counts import count_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = count_tokens(docs, path, limit=100, common=5).collect()
    want = sorted((-1 if d is None else d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in ROWS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert count_tokens(none, path).count() == 0


def test_token_counts_of_a_byte_level_tokenizer(spark, tmp_path):
    """A tokenizer whose pre-tokens start with a space, and pre-tokens too long
    for the join."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers

    from docloom.llm.token_counts import count_tokens

    alphabet = pre_tokenizers.ByteLevel.alphabet()
    tok = Tokenizer(models.BPE({c: i for i, c in enumerate(sorted(alphabet))}, []))
    tok.pre_tokenizer, tok.decoder = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel()
    path = str(tmp_path / "bytes.json")
    tok.save(path)
    rows = [(1, "hello world again"), (2, "hello world again"), (None, " a  b"), (3, "x" * 3000 + " y"), (3, "x" * 3000 + " y"), (4, None), (5, "")]
    for common in (0, 2, 100):
        out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, common=common).collect()
        want = [(i or -1, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
        assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == sorted(want)


@pytest.mark.parametrize("t", ["İstanbul ΣΑΣ ς", "a<|startoftext|>b<|ENDOFTEXT|>", "x́ é  y", "'s''ll I'M 12½²", "ǅ ß ẞ ſ K", "\x1c\x85 a​b", "😀👍🏽 日本語!"])
def test_pre_tokens_equal_the_library(t):
    from docloom.llm.token_counts import load, pieces_of, pre_tokens

    tools = load(public_tokenizers.path("word_bpe_49k.json"))
    words, special = pre_tokens(*tools, t)
    assert special + sum(pieces_of(tools[0], w) for w in words) == len(tools[0].encode(t, add_special_tokens=False).ids)


def test_piece_codec(docs, none):
    from docloom.llm.piece_codec import decode, encode, library

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = encode(docs, path)
    assert set(docs.columns) < set(out.columns)
    for r in decode(out, path).withColumnRenamed("decoded", "back").collect():
        assert list(r.piece_ids) == library(path).encode(r.text or "")
        assert r.run_parity and r.run_round_trip and r.back == (r.text or "") and r.n_pieces == len(r.piece_ids)
    assert encode(none, path).count() == 0


def test_piece_codec_texts():
    from docloom.llm.piece_codec import coder_of, library

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["", " ", "  a  b ", "▁x ▁", "<s> a </s>", "\x00\t\n", "日本語😀", "a" * 5000, "é  z"]
    ids, same, kept = coder_of(path, 1).code(texts)
    assert [x.tolist() for x in ids] == library(path).encode(texts) and all(same) and all(kept)


def test_html():
    from docloom.llm.html_text import main_text

    body = "A long sentence, with words; and signs. " * 8
    page = f"<html><head><title>T</title><script>x('</p>')</script></head><body><nav><a>Home</a></nav><div class='cookie-bar'>Cookies!</div><article><h1>T &amp; U</h1><p>{body}<br>two\n  lines<p>Of.</p><form>Mail</form><section class='comments'><p>Nice, really.</p></section></article><aside>More</aside><footer>(c)</footer></body></html>"
    assert main_text(page) == "\n".join(["T & U", body.strip(), "two lines", "Of."])
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text(f"<div><a href=1>a b c</a></div><div id=x><p>{body}</p></div>") == body.strip()


def test_html_names_do_not_drop_text():
    from docloom.llm.html_text import main_text

    body = "A long sentence, with words; and signs. " * 8
    page = f"<body><div class='menu'>Home. About, more.</div><article><div class='post-header'><h1>Title</h1></div><div class='legal-analysis'><p>{body}</p></div><div class='related-work'><p>{body}</p></div><p>{body}</p><div class='comments'>{body}</div></article></body>"
    assert main_text(page) == "\n".join(["Title", *[body.strip()] * 3])


P = "A long paragraph, with words; and signs. " * 7 + "End."


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p>See <span class="ad">AD</span> this text, ok.</p>', "See this text, ok."),
        ("<p>x<span hidden>no</span>y <a class=share>Share</a>z</p>", "xy z"),
        (f'<body><form id="aspnetForm"><h1>T</h1><p>{P}</p><p>{P}</p><input value=x><label>Name</label></form>', f"T\n{P}\n{P}"),
        (f"<article><p>{P}</p><form>Mail <input> <button>Send</button></form></article>", P),
        (f'<article class="page"><h1>T</h1><article class="post"><p>{P}</p></article></article>', f"T\n{P}"),
        (f"<article><p>{P}</p><article><p>{P}</p></article></article>", P),
        (f'<article><h1>T</h1><p>{P}</p><section class="related"><p>{P}</p></section><section id="search"><p>{P}</p></section><div class="menu"><a>Home</a></div></article>', f"T\n{P}\n{P}\n{P}"),
        (f'<div class="content"><h1>Main</h1><p>{P}</p><p>{P}</p></div><article>Teaser one, read</article><article>Teaser two, read</article>', f"Main\n{P}\n{P}"),
        (f'<div class="entry"><h1>T</h1><div class="meta">By A</div><div class="txt"><p>{P}</p></div></div><div class="promo">Buy our things, now.</div>', f"T\nBy A\n{P}"),
        (f"<div class='header'>Site</div><article><div class='header'><h1>T</h1></div><p>{P}</p></article>", f"T\n{P}"),
        ("<p>Before <img src=x> after</p>", "Before after"),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>", "Let x=1 be."),
    ],
)
def test_html_by_hand(page, want):
    from docloom.llm.html_text import main_text

    assert main_text(page) == want


def test_html_threshold_decides_in_articles():
    """Which parts of an article go is a matter of their ratios: a box of links
    with few other words."""
    from docloom.llm.html_text import main_text

    page = f"<article><h1>T</h1><p>{P}</p><p>{P}</p><div class=box><a href=1>One more of these here</a> and <a href=2>another of them</a></div></article>"
    assert main_text(page) == f"T\n{P}\n{P}"
    assert main_text(page, 0.0).endswith("and another of them")
    prose = page.replace("and", f"and {P}")
    assert main_text(prose).endswith("another of them")


def test_html_ratios_by_brute_force():
    """Well-formed pages without names, through another parser and plain sums."""
    from html.parser import HTMLParser

    from docloom.llm.html_text import PROSE, PUNCTUATION, SCOPES, main_text

    class Blocks(HTMLParser):
        def __init__(self, page):
            super().__init__()
            self.path, self.out = [], []
            self.feed(page)

        def handle_starttag(self, tag, attrs):
            self.path.append((tag, dict(attrs).get("class", "")))

        def handle_endtag(self, tag):
            self.path.pop()

        def handle_data(self, data):
            linked = any(t == "a" for t, _ in self.path)
            self.out.append((tuple(x for x in self.path if x[0] != "a"), " ".join(data.split()), linked))

    r = np.random.default_rng(8)
    some = lambda: " ".join(r.choice(WORDS, r.integers(1, 60))) + "." * int(r.integers(0, 3))
    cut = 0
    for _ in range(60):
        parts = []
        for _ in range(r.integers(1, 5)):
            inner = "".join(f"<{t}>{some()}</{t}>" for t in r.choice(["p", "h2", "pre"], r.integers(1, 5)))
            parts.append(f"<div class='{r.choice(['a', 'b', 'c'])}' id='i{r.integers(1000)}'>{inner}</div>" if r.random() < 0.7 else f"<section><a>{some()}</a></section>")
        page = f"<html><body>{''.join(parts)}</body></html>"
        found = Blocks(page).out
        paths = [p for p, *_ in found]
        fused = []
        values = []
        for p in paths:
            mine = [(0 if linked else len(t), len(PUNCTUATION.findall(t))) for q, t, linked in found if q == p]
            values.append((sum(a for a, _ in mine) / len(mine), 1 + sum(b for _, b in mine) / len(mine)))
        for i in range(len(found)):
            f = 1.0
            for k in (0, 1):
                near = [(math.exp(-((j - i) ** 2) / 4), values[j][k]) for j in range(len(found)) if abs(j - i) <= 2]
                f *= math.sqrt(values[i][k] * sum(w * v for w, v in near) / sum(w for w, _ in near))
            fused.append(f)
        ratio = {p: np.mean([f for q, f in zip(paths, fused, strict=True) if q == p]) for p in paths}
        content = {p for p in paths if ratio[p] >= 0.1 * max(ratio.values())}
        box = lambda p: p if p[-1][0] in SCOPES else p[:-1]
        free = lambda t, linked: 0 if linked else len(t)
        held = {box(p): sum(free(t, k) for q, t, k in found if box(q) == box(p) and q in content) for p in paths}
        main = next(c for c in held if held[c] == max(held.values()))
        full = {box(p) for p, t, k in found if p in content and free(t, k) >= PROSE and PUNCTUATION.search(t)}
        inside = {main} | (full & {box(p) for p in content})
        want = [t for p, t, _ in found if any(p[: len(c)] == c for c in inside)]
        assert main_text(page) == "\n".join(want)
        cut += len(want) < len(found)
    assert cut >= 5


def test_html_long_pages_take_time_in_proportion():
    import time

    from docloom.llm.html_text import main_text

    body = "A long sentence, with words; and signs. "
    start = time.process_time()
    for page in ("".join(f"<section id=s{i}><p>{body}</section>" for i in range(8000)), "<div>" * 8000 + body + "</div>" * 8000, "<li>" + "<b>" * 8000 + "<table>" + "<i>" * 8000 + f"<li>{body}" * 8000):
        assert main_text(page).split("\n")[-1] == body.strip()
    assert time.process_time() - start < 10


def test_html_extract(spark):
    from docloom.llm.html_text import extract

    pages = spark.createDataFrame([(1, "u", None, "z"), (2, None, "<p>é x", "z"), (2, None, "<p>é x", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract(pages).collect()) == [(1, "", 0), (2, "é x", 3), (2, "é x", 3)]
    assert extract(pages.limit(0)).count() == 0


def test_jaccard_join(spark, none):
    from docloom.llm.jaccard_join import join

    base = text(50, 200).split()
    rows = list(ROWS)
    for i in range(60):  # a large group of near copies
        w = list(base)
        w[3 * i] = "changed"
        rows.append((1000 + i, " ".join(w), "en", "s"))
    df = spark.createDataFrame([r + (0, 0, "k", 0, 0.0) for r in rows], SCHEMA)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.n_links, r.n_copies) for r in join(df, tile=16).collect())
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, copies = [0] * len(rows), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            equal = (rows[i][1] or "") == (rows[j][1] or "")
            near = sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
            if equal or near:
                for k in (i, j):
                    (copies if equal else links)[k] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, *_) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    want = sorted((-1 if d is None else d, low[find(i)], links[i], copies[i]) for i, (d, *_) in enumerate(rows))
    assert [str(x) for x in got] == [str(x) for x in want]
    assert join(none).count() == 0


def test_labels_agree_as_often_as_texts_are_alike():
    import pandas as pd

    from docloom.llm.jaccard_join import labels_of, shingles

    r, share, true = np.random.default_rng(11), [], []
    for i in range(150):
        w = text(300 + i, 200).split()
        v = list(w)
        for j in r.choice(200, r.integers(1, 12), replace=False):
            v[j] = f"x{j}"
        x, y = labels_of(pd.Series([" ".join(w), " ".join(v)]), 32, 10)["labels"]
        share.append((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean())
        a, b = (set(shingles(" ".join(t)).tolist()) for t in (w, v))
        true.append(len(a & b) / len(a | b))
    off = np.array(share) - np.array(true)
    assert abs(off.mean()) < 0.01 and off.std() < 0.035  # 320 draws: 0.028 at most


def test_prefix_is_shortened_until_the_recall_is_met():
    from docloom.llm.jaccard_join import prefix_length, recalls

    r = np.random.default_rng(2)
    true = r.choice([0.81, 0.84, 0.93], 40_000)  # likenesses of pairs; what is seen of them
    seen = true[r.random(len(true)) < recalls(true, 32, 10)[:, -1]]
    k = prefix_length(0.8, 32, 10, 0.9995, seen)
    measured = [np.array([recalls(true[true < 0.85], 32, 10)[:, i].mean(), recalls(true[true > 0.9], 32, 10)[:, i].mean()]).min() for i in range(10)]
    assert k == max(i for i in range(10) if measured[i] >= 0.9995) + 1 < 10
    assert prefix_length(0.8, 32, 10, 0.9995, np.full(9, 0.97)) > k  # like pairs only: longer prefixes do
    none = prefix_length(0.8, 32, 10, 0.9995, np.zeros(0))
    assert recalls(np.array([0.8]), 32, 10)[0, none - 1] >= 0.9995 > recalls(np.array([0.8]), 32, 10)[0, none]
    assert prefix_length(0.8, 1, 4, 1.0, seen) == 1


def test_subtrees_across_partitions(spark):
    """5,000 texts in one subtree, over many partitions, are one component; so
    are those of a subtree that fills no more than a border."""
    from docloom.llm.jaccard_join import components, subtree_edges

    rows = [(bytes([0, 7, 7, i % 3]), i) for i in range(5000)] + [(bytes([1, 7, 7, i % 5]), 10_000 + i) for i in range(20)] + [(bytes([1, 7, 8 + i, 0]), 20_000 + i) for i in range(9)]
    for n in (1, 7, 40):
        tries = spark.createDataFrame(rows, "path binary, key long").repartitionByRange(n, "path", "key").sortWithinPartitions("path", "key")
        found = {}
        for r in components(subtree_edges(tries, 2)).collect():
            found.setdefault(r.root, set()).add(r.node)
        assert found == {0: set(range(5000)), 10_000: set(range(10_000, 10_020))}


def classes_by_brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, class_id, n_links) with links from shared shingles, which are
    all counted; shingles as sets of words."""
    import collections

    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    names = list(texts)
    sets, owners = [], collections.defaultdict(list)
    for k, t in enumerate(names):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        for x in sets[-1]:
            owners[x].append(k)
    root, links = list(range(len(names))), [0] * len(names)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(names)):
        shared = collections.Counter(b for x in sets[a] for b in owners[x] if b < a)
        for b, n in shared.items():
            if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
                links[a] += len(texts[names[b]])
                links[b] += len(texts[names[a]])
                root[find(a)] = find(b)
    low = {}
    for k, t in enumerate(names):
        low[find(k)] = min([low.get(find(k), math.inf), *texts[t]])
    return sorted((i, low[find(k)], links[k]) for k, t in enumerate(names) for i in texts[t])


def test_jaccard_join_finds_all_links_of_the_table(spark):
    """The whole sf0.1 table against all pairs that share a shingle."""
    from docloom.llm.jaccard_join import join

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in join(docs.repartition(8)).collect())
    assert got == classes_by_brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_jaccard_join_of_a_large_group(spark):
    """2,000 near copies of one text, so that most labels are equal."""
    from docloom.llm.jaccard_join import join

    base, r = text(60, 120).split(), np.random.default_rng(6)
    rows = []
    for i in range(2000):
        w = list(base)
        for j in r.choice(120, r.integers(1, 4), replace=False):
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == classes_by_brute_force(rows)


def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        bad, poor = i % 4 == 0, i % 5 == 0
        t = text(i, 60)
        if bad:
            w = t.split()
            for j in range(5, 60, 15):
                w[j] = ["fiend", "ogre"][(i // 4 + j) % 2]
            t = " ".join(w)
        if poor:
            t = " ".join(x + "%%%" for x in t.split())
        rows.append((i, t, "en", "s", len(t), 0, "k", 0, 0.0))
        labels.append((i, int(not poor), int(bad)))
    rows += [(900, None, "en", "s", 0, 0, "k", 0, 0.0), (901, "", "en", "s", 0, 0, "k", 0, 0.0), (1, rows[1][1], "en", "s", 0, 0, "k", 0, 0.0)]
    labels += [(902, None, None), (None, 1, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)


def test_toxicity(spark, none):
    from docloom.llm.toxicity import drop_toxic, toxicity

    docs, labels = labelled(spark)
    rows = toxicity(docs, labels).collect()
    assert len(rows) == 603
    truth = {i: i % 4 == 0 for i in range(600)}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum((r.predicted == 1) == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and all(r.predicted == 0 for r in rows if r.doc_id >= 900)
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = [texts[r.doc_id][s.start : s.end] for r in rows for s in r.spans]
    assert spans and sum(s in ("fiend", "ogre") for s in spans) >= 0.95 * len(spans)
    assert drop_toxic(docs, labels).columns == docs.columns
    assert toxicity(none, labels).count() == 0 and toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0


def test_marginals_equal_enumeration():
    import itertools

    from docloom.llm.toxicity import expectations

    r = np.random.default_rng(0)
    u, on, tr = r.normal(size=(5, 3)), np.ones((5, 3), bool), r.normal(size=(2, 2))
    on[3:, 1] = False
    p, moves = expectations(u, on, tr)
    total = np.zeros((2, 2))
    for c in range(3):
        n = int(on[:, c].sum())
        z, q, mv = 0.0, np.zeros(5), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(u[i, c] * y[i] for i in range(n)) + sum(tr[y[i], y[i + 1]] for i in range(n - 1)))
            z += w
            q[:n] += w * np.array(y)
            for i in range(n - 1):
                mv[y[i], y[i + 1]] += w
        assert np.allclose(q / z, p[:, c])
        total += mv / z
    assert np.allclose(total, moves)


def tagger_of(seed: int):
    from docloom.llm.toxicity import BITS, Tagger

    r = np.random.default_rng(seed)
    t = Tagger()
    t.w = r.normal(size=1 << BITS).astype(np.float32) * 0.6
    t.w[0] = -0.5
    t.trans = np.array([[1.5, -1.0], [-1.0, 1.5]])
    t.slope, t.offset = 1.3, 0.4
    return t


def test_toxicity_scores_by_enumeration(spark):
    """Scores and spans of short texts from all labellings of their tokens."""
    import itertools

    from docloom.llm.toxicity import TOKEN, features, scored

    t = tagger_of(4)
    texts = [text(i, i % 9) for i in range(30)] + [None, "", "One, TWO 3! a1", "x", "x"]
    rows = scored(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"), t).select("doc_id", "_toxic.*").collect()
    marked = 0
    for row in rows:
        x = texts[row.doc_id] or ""
        found = list(TOKEN.finditer(x))
        n = len(found)
        p = np.zeros(n)
        if n:
            own, ahead, behind = features([f[0] for f in found])
            u = t.w[own].sum(1)
            u[1:] += t.w[ahead][:-1]
            u[:-1] += t.w[behind][1:]
            z = 0.0
            for y in itertools.product((0, 1), repeat=n):
                w = math.exp(sum(float(u[i]) * y[i] for i in range(n)) + sum(t.trans[y[i], y[i + 1]] for i in range(n - 1)))
                z += w
                p += w * np.array(y)
            p /= z
        e = p[p >= 0.1].sum()
        assert abs(row.n_toxic - e) < 1e-3 and abs(row.score - 1 / (1 + math.exp(-(1.3 * math.log(e + 0.01) + 0.4)))) < 1e-3
        spans = []
        for i in np.flatnonzero(p >= 0.5):
            if spans and spans[-1][2] == i - 1:
                spans[-1] = [spans[-1][0], found[i].end(), i]
            else:
                spans.append([found[i].start(), found[i].end(), i])
        assert [[s.start, s.end] for s in row.spans] == [s[:2] for s in spans]
        marked += len(spans)
    assert marked > 10


def test_messages_pass_whole_texts():
    """Chains of many windows against plain recursion over each text."""
    from docloom.llm.toxicity import features

    t = tagger_of(5)
    t.trans = np.array([[3.0, -3.0], [-3.0, 3.0]])  # what is said far away matters
    docs = [text(i, n).split() for i, n in enumerate([0, 1, 63, 64, 65, 128, 129, 1000, 0, 5000])]
    m = np.exp(t.trans)
    for tokens, got in zip(docs, t.tag(docs), strict=True):
        if not tokens:
            assert not len(got)
            continue
        own, ahead, behind = features(tokens)
        u = t.w[own].sum(1).astype(float)
        u[1:] += t.w[ahead][:-1]
        u[:-1] += t.w[behind][1:]
        e = np.stack([np.ones_like(u), np.exp(u)], 1)
        f, b = np.zeros_like(e), np.ones_like(e)
        for i in range(len(u)):
            f[i] = e[i] * (f[i - 1] @ m if i else 1)
            f[i] /= f[i].sum()
        for i in range(len(u) - 2, -1, -1):
            b[i] = m @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = f * b
        assert np.allclose(got, p[:, 1] / p.sum(1), atol=2e-4)


def test_toxicity_finds_held_out_documents(spark):
    """The sf0.1 table: recall, false alarms and order on labels held out."""
    from docloom.llm.toxicity import toxicity

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = toxicity(spark.read.parquet(f"{folder}/documents.parquet").repartition(8), labels).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    bad, good = out[out.toxic == 1], out[out.toxic == 0]
    rank = out.score.rank()[bad.index].sum() - len(bad) * (len(bad) + 1) / 2
    assert rank / len(bad) / len(good) >= 0.917
    assert bad.predicted.mean() >= 0.84 and good.predicted.mean() <= 0.013


def test_quality(spark, none):
    from docloom.llm.quality import keep_good, resample

    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in resample(docs, labels, share=0.8).collect() if r.doc_id < 600}
    assert sum(rows[i].selected == (i % 5 != 0) for i in range(600)) >= 590
    rows = {r.doc_id: r for r in resample(docs, labels).collect() if r.doc_id < 600}  # k by the share of good labels outside the held-out third
    assert sum(rows[i].selected == (i % 5 != 0) for i in range(600)) >= 580
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id < 600} == {i for i, r in rows.items() if r.selected}
    assert resample(none, labels).count() == 0
    assert resample(docs, labels, share=0.5).filter("selected").count() in (301, 302)  # half of 603; equal rows share a key
    assert resample(docs, labels.limit(0)).filter("not selected").count() == 0


def test_quality_weights_by_brute_force(spark):
    """Log weights from plain counts of n-grams, for nulls, empty, long and
    repeated texts too; held-out labels teach nothing."""
    from docloom.llm.quality import grams, resample

    rows = [(i, text(i, 30 + i) + " good" * (i % 3), -1.0) for i in range(60)] + [(100, None, 0.0), (101, "", 0.0), (102, " ~~ " + text(1, 20_000), 0.0), (3, text(3, 33), 0.0), (3, text(3, 33), 0.0), (None, "é É", 0.0)]
    marks = [(i, int(i % 3 > 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key double")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    n = 10_000
    of = [list(r.g) for r in docs.select(grams(F.col("text"), n).alias("g")).collect()]
    good = {i for i, q in marks if q and not held(i)}
    raw, target = np.ones(n), np.ones(n)
    for (i, *_), g in zip(rows, of, strict=True):
        np.add.at(raw, g, 1)
        if i in good:
            np.add.at(target, g, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted((-1 if i is None else i, len(g), round(100 * float(ratio[g].mean()) if g else 0.0, 6)) for (i, *_), g in zip(rows, of, strict=True))
    got = resample(docs, labels).collect()
    assert np.allclose(np.array(sorted((-1 if r.doc_id is None else r.doc_id, r.n_grams, r.log_weight) for r in got)), np.array(want), atol=1e-5)
    t = re.findall(r"\w+|[^\w\s]+", (rows[0][1] or "").lower())
    assert len(of[0]) == 2 * len(t) - 1
    k = round(len([i for i in good]) / len([i for i, _ in marks if not held(i)]) * len(rows))
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert all(r.selected == (r.gumbel_key >= keys[k - 1]) for r in got)


def test_quality_inclusion_follows_weights(spark):
    """Over many seeds, texts are among the first one and the first two as
    often as drawing without replacement by weight has it."""
    import itertools

    from docloom.llm.quality import keyed

    ratio = np.linspace(-1.5, 1.5, 64)
    docs = spark.createDataFrame([(i, text(i, 12)) for i in range(6)], "doc_id long, text string").crossJoin(spark.range(6000).withColumnRenamed("id", "seed"))
    rows = keyed(docs, ratio, F.col("seed"), 3.0).select("seed", "doc_id", "_log_weight", "_key").toPandas()
    w = np.exp(rows.groupby("doc_id")["_log_weight"].first().to_numpy())
    w /= w.sum()
    rank = rows.sort_values("_key", ascending=False).groupby("seed").cumcount()
    first = rows[rank.reindex(rows.index) == 0].groupby("doc_id").size().reindex(range(6), fill_value=0).to_numpy() / 6000
    two = rows[rank.reindex(rows.index) <= 1].groupby("doc_id").size().reindex(range(6), fill_value=0).to_numpy() / 6000
    both = np.zeros(6)
    for a, b in itertools.permutations(range(6), 2):
        both[[a, b]] += w[a] * w[b] / (1 - w[a])
    assert w.max() > 3 * w.min() and np.abs(first - w).max() < 0.03 and np.abs(two - both).max() < 0.03


def test_quality_keeps_good_documents(spark):
    """Held-out labels of the sf0.1 table: what is kept of either class."""
    from docloom.llm.common import hold_out
    from docloom.llm.quality import resample

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = resample(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels.filter(hold_out(F.col("doc_id"))), "doc_id")
    kept = {r.quality: r.kept for r in out.filter("quality is not null").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("kept")).collect()}
    assert kept[1] >= 0.97 and kept[0] <= 0.15


def test_ordinal(spark):
    from docloom.llm.common import ordinal

    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 7)).repartition(7)
    rows = ordinal(df, ["g"], [F.col("id").desc()], "i").collect()
    want = {}
    for r in sorted(rows, key=lambda r: -r.id):
        assert r.i == want.get(r.g, 0)
        want[r.g] = r.i + 1


def test_image_copies(spark):
    from docloom.llm.image_copies import find_copies

    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=64)], i) for i in range(60)]
    rows += [(50, None, 0), (100, rows[7][1], 0), (101, rows[7][1], 0), (None, rows[8][1], 0), (150, [], 0)]
    out = find_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>, media int")).collect()
    true = {(q.query_id, q.media_id) for q in out}
    assert (0, 0) in true and (50, 50) in true and (100, 7) in true and len(true) <= 4
    assert [q.n_same for q in out if (q.query_id, q.media_id) == (100, 7)] == [3]
    assert find_copies(spark.createDataFrame([], "vec_id long, embedding array<float>, media int")).count() == 0


def test_image_copies_of_repeated_corners(spark):
    """Exactly the pairs of descriptors within the distance that share a key
    are found, whatever the parts, and pictures of many equal corners give no
    rows but the pairs of pictures."""
    from docloom.llm import image_copies as I

    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, (4, 30), dtype=np.uint64)
    b = np.concatenate([a, r.integers(0, 2**63, (4, 70), dtype=np.uint64)], 1)
    for j in range(30):  # j + 11 flipped bits, in all words alike
        for k in r.choice(256, j + 11, replace=False):
            b[k // 64, j] ^= np.uint64(1) << np.uint64(k % 64)
    d = sum(np.bitwise_count(a[w][:, None] ^ b[w][None]).astype(int) for w in range(4))
    a, b = np.concatenate([a, a[:, :5]], 1), np.concatenate([b, a[:, :20], np.repeat(a[:, :1], 50, 1)], 1)  # also equal ones
    d = sum(np.bitwise_count(a[w][:, None] ^ b[w][None]).astype(int) for w in range(4))
    share = np.any([x[:, None] == y[None] for x, y in zip(I.keys_of(a), I.keys_of(b), strict=True)], axis=0)
    want = set(zip(*(x.tolist() for x in np.nonzero((d <= 40) & share)), strict=True))
    cuts = np.array([0, 3, 40, 41, 90, 120])
    for step in (1, 7, 1 << 20):
        parts = list(I.HammingTables(a).near(b, cuts, 40, step))
        got = [x for i, j in parts for x in zip(i.tolist(), j.tolist(), strict=True)]
        assert set(got) == want and len(got) == len(want)
        where = [set(np.searchsorted(cuts, j, "right")) for _, j in parts]
        assert sum(map(len, where)) == len(set().union(*where))  # whole pictures
    assert want >= set(zip(*(x.tolist() for x in np.nonzero(d <= 12)), strict=True)) and len(want) > 100
    # turns on both sides of 0 are one model
    q = np.array([[10.0 * i, 7.0 * i, 1, 1.0] for i in range(6)])
    m = q + [5, 5, 0, 0] + np.array([[0, 0, 0, 0.01 * (-1) ** i] for i in range(6)])
    assert [(x[0], x[1]) for x in I.consensus(q, m, np.full(6, 9), 5)] == [(9, 6)]
    vectors = [(i, [float(x) for x in r.normal(size=64)]) for i in range(300)]
    out = I.find_copies(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), every=10)
    got = {(x.query_id, x.media_id) for x in out.collect()}
    assert sum((i, i) in got for i in range(0, 300, 10)) >= 27 and sum(a != b for a, b in got) <= 3


def test_image_copies_of_pictures(spark):
    """Pictures as pixels and as files; and of the copies that are turned,
    scaled or small crops, all that a brute-force join of descriptors finds."""
    from docloom.llm import image_copies as I

    r = np.random.default_rng(5)
    images = [np.kron(r.random((40, 40)), np.ones((6, 6))) for _ in range(6)]  # detailed: many corners
    assert len(I.describe(images[0])[0]) > 2 * 28
    edits = {"turned": lambda a: np.rot90(a), "scaled": lambda a: I.resized(a, 0.7), "small crop": lambda a: a[90:150, 60:120]}
    edits |= {"half": lambda a: I.resized(a, 0.5), "twice": lambda a: I.resized(a, 2), "half crop, darker": lambda a: 0.7 * a[:120, 100:220]}
    files = [b"P5\n# grey\n%d %d\n255\n" % a.shape[::-1] + np.rint(a * 255).astype(np.uint8).tobytes() for a in images]
    library = spark.createDataFrame(list(enumerate(files)) + [(90, None), (91, b""), (92, files[2])], "id long, image binary")
    for f in edits.values():
        queries = [f(a) for a in images]
        got = I.find_images(library, spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "id long, image array<array<double>>"), "id", "image").collect()
        want = set()
        for i, q in enumerate(queries):
            qp, qd = I.describe(q, I.PYRAMID)
            for j, c in enumerate(files):
                mp, md = I.describe(I.pixels(c))
                a, b = np.nonzero(sum(np.bitwise_count(x[:, None] ^ y[None]).astype(np.uint16) for x, y in zip(qd.view(np.uint64).T, md.view(np.uint64).T, strict=True)) <= 40)
                if len(a) and I.consensus(qp[a], mp[b], np.full(len(b), j), 5):
                    want.add((i, j))
        assert {(g.query_id, g.media_id) for g in got} == want and {(i, i) for i in range(6)} <= want
        assert all(g.n_same == 1 + (g.media_id == 2) for g in got)


def test_image_copies_pairing_tasks(spark):
    """Pictures and queries that were described in many partitions are paired
    in few tasks, as many as their corners ask for, with the same results."""
    from docloom.llm import image_copies as I

    r = np.random.default_rng(8)
    media = spark.createDataFrame([(i, [float(x) for x in r.normal(size=64)]) for i in range(48)], "media long, image array<float>")
    drawn = lambda v, _: I.draw(np.asarray(v, np.float32))
    found = []
    for n in (1, 24):
        points = I.cut(I.described(media.repartition(n), drawn))
        asked = I.cut(I.described(media.repartition(n), lambda v, key: I.edit(drawn(v, key), key), I.PYRAMID))
        got = I.matched(points, asked, 40, 5)
        assert got.rdd.getNumPartitions() == 1
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1] and sum(x[0] == x[1] for x in found[0]) >= 45
    # bundles that are full stay as they are; of smaller ones no corner is lost, and pictures stay whole
    corners = I.opened(*points.agg(*[F.expr(f"unhex(array_join(collect_list(hex({c})), ''))") for c in points.columns]).first())
    for most, together in ((500, 1), (500, 3), (1 << 14, 4)):
        parts = [I.opened(*x) for x in I.gathered(points, most, together).collect()]
        assert sum(len(x[0]) >= most for x in parts) <= len(corners[0]) // most
        of = np.concatenate([x[0] for x in parts])
        assert np.array_equal(np.bincount(of), np.bincount(corners[0])) and sum(len(set(x[0])) for x in parts) == len(set(of))
        assert {tuple(x) for x in np.concatenate([x[2] for x in parts], 1).T} == {tuple(x) for x in corners[2].T}
        full = -(-len(of) // most)
        assert I.gathered(points, most, together).rdd.getNumPartitions() == min(24, -(-full // together))
    assert I.gathered(points.limit(0)).count() == 0


def test_image_copies_meet_few_pictures():
    """only pictures that share a part are compared, not every query with
    all, and none is missed that a comparison of all finds."""
    from docloom.llm import image_copies as I

    r = np.random.default_rng(21)
    images = [I.draw(r.normal(size=64)) for _ in range(120)]
    pack = lambda all_: (np.repeat(np.arange(len(all_)), [len(p) for p, _ in all_]), *(np.concatenate(x) for x in zip(*all_, strict=True)))
    of, points, bits = pack([I.describe(a) for a in images])
    q_of, q_points, q_bits = pack([I.describe(I.edit(a, i), I.PYRAMID) for i, a in enumerate(images[:40])])
    words, q_words = (np.ascontiguousarray(x.view(np.uint64).T) for x in (bits, q_bits))
    cuts = I.starts_of(of)
    a, b = I.neighbours(points, cuts)
    assert all(np.array_equal(np.sort(x), np.sort(y)) for x, y in zip((a, b), I.neighbours(points, cuts, 50), strict=True))
    for i in range(0, len(points), 97):
        d = np.hypot(*(points[:, :2] - points[i, :2]).T)
        d[(of != of[i]) | (points[:, 2] != points[i, 2]) | (np.arange(len(d)) == i)] = np.inf
        assert np.allclose(np.sort(d[b[a == i]]), np.sort(d)[: (a == i).sum()], atol=1e-3) and (a == i).sum() == min(6, np.isfinite(d).sum())
    block = I.PairTables(q_of, q_points, q_words)
    found = [set(zip(*(x.tolist() for x in block.candidates(points, words, cuts, 40, step)), strict=True)) for step in (1 << 18, 1000)]
    assert found[0] == found[1] and len(found[0]) < 0.02 * 40 * 120
    want = set()
    for q in range(40):
        for m in range(120):
            i, j = (np.concatenate(x) for x in zip(*I.near_all(q_words[:, q_of == q], words[:, of == m], 40, 1000), strict=True))
            if len(i) and I.consensus(q_points[q_of == q][i], points[of == m][j], np.zeros(len(i), int), 6):
                want.add((m, q))
    assert sum(m == q for m, q in want) >= 38 and want & {(i, i) for i in range(40)} <= found[0]
    assert len(I.PairTables(q_of[:1], q_points[:1], q_words[:, :1]).candidates(points, words, cuts, 40)[0]) == 0  # no pair of corners


def test_sums_in_parts(monkeypatch):
    """Training adds pairs in parts, with the sums that all at once give."""
    from docloom.llm import toxicity as T

    r = np.random.default_rng(3)
    to, of, values = r.integers(0, 50, 1000), r.integers(0, 80, 1000), r.standard_normal(80)
    for pairs in (7, 1000, 5000):
        monkeypatch.setattr(T, "PAIRS", pairs)
        assert np.allclose(T.added(to, values, of, 60), np.bincount(to, values[of], 60))
    assert not T.added(to[:0], values, of[:0], 4).any()
