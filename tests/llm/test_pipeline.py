"""The pipeline against a brute-force version, stage by stage, each on its own input."""

import hashlib
import re
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import corpus_pipeline as c
import edge
import pytest
import test_line_dedup as by_lines
import test_mixing as by_mixing
import test_quality as by_rules
import tiktoken

from tessera.llm import byte_bpe
from tessera.llm.common import stored

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in c.STAGES:
        after = stored(stage(spark, docs, sf), "t")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_columns_and_run(steps, spark, sf):
    columns = steps[0][1].columns
    assert 4 <= len(steps) <= 5 and all(after.columns == columns for _, _, after in steps[:-1])
    assert sorted(r.ids_sha256 for r in c.run(spark, sf).collect()) == sorted(r.ids_sha256 for r in steps[-1][2].collect())
    assert c.ORACLE_SQL is None


def of_rules(rows):
    return {i: (left, kept) for i, (kept, left, _) in by_rules.by_lines(rows).items()}


def test_quality(steps):
    """By the rules for lines as well: what stays is what they leave, of the documents that they keep."""
    want = {i: left for i, (left, kept) in of_rules([(r.doc_id, r.source, r.text) for r in steps[0][1].collect()]).items() if kept}
    assert texts(steps[0][2]) == want


def test_quality_where_lines_go(spark, sf):
    """A host with a menu in a third of its documents: lines go from texts, and documents that were little else go."""
    menu = "home about contact imprint privacy search login basket help"
    prose = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    rows = [(i, "host", f"{menu}\n{prose(i)}" if i % 3 == 0 else prose(i)) for i in range(60)]
    rows += [(100 + i, "host", "\n".join([menu, f"{' '.join(f'k{i}x{j}' for j in range(45))}"] + [menu.upper() + " "] * 3)) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(c.STAGES)["quality rules"](spark, docs, sf)
    want = {i: left for i, (left, kept) in of_rules(rows).items() if kept}
    assert texts(out) == want and all(r.n_chars == len(r.text) for r in out.collect())
    assert menu not in "".join(want.values()) and 0 in want and not {100, 101, 102} & set(want)


def test_lines(steps):
    rows = [(r.doc_id, r.text) for r in steps[1][1].collect()]
    want = {i: kept for i, _, _, kept in by_lines.brute(rows)}
    assert texts(steps[1][2]) == want
    assert all(r.n_chars == len(r.text) for r in steps[1][2].collect())


def test_near_duplicates(steps):
    before, after = texts(steps[2][1]), texts(steps[2][2])
    sets = {}
    for i, t in before.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    inverse = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverse[x].append(i)
    sim = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for v in inverse.values() for p in combinations(sorted(v), 2)}
    assert not [p for p, j in sim.items() if j >= 0.8 and p[0] in after and p[1] in after]
    gone = set(before) - set(after)
    assert all(max(j for p, j in sim.items() if i in p) >= 0.74 for i in gone)
    assert all(before[i] == after[i] for i in after)


def test_mixture(steps):
    before, taken = texts(steps[3][1]), Counter(r.doc_id for r in steps[3][2].collect())
    source = {r.doc_id: r.source for r in steps[3][1].collect()}
    n = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in before.items()}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += n[i]
    assert max(taken.values()) <= 2
    for s, goal in by_mixing.targets(dict(sizes)).items():
        mine = [i for i in before if source[i] == s]
        assert abs(sum(taken[i] * n[i] for i in mine) - goal) <= max(n[i] for i in mine)


def test_tokens(steps):
    with open(byte_bpe.vocabulary_path(), "rb") as f:
        ranks = byte_bpe.Vocabulary(f.read()).ranks
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(reference.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in steps[4][1].collect())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in steps[4][2].collect()) == want


def test_two_at_once(spark, sf):
    """Two threads: neither deletes what the other has stored, and nothing stays but the last stage's input."""
    with ThreadPoolExecutor(2) as pool:
        both = [x.result() for x in [pool.submit(lambda: sorted(r.ids_sha256 for r in c.run(spark, sf).collect())) for _ in range(2)]]
    assert both[0] == both[1]


def test_edge_rows(spark, sf):
    docs = edge.documents(spark)
    for _, stage in c.STAGES:
        docs = stored(stage(spark, docs, sf), "t")
    nothing = edge.empty(spark)
    for _, stage in c.STAGES:
        nothing = stored(stage(spark, nothing, sf), "t")
    assert nothing.count() == 0


def test_edge_rows_by_stage(spark, sf):
    """What each stage gives for nulls, blank and long texts, repeated rows, missing ids and clashing names."""
    docs = edge.documents(spark)
    stage = dict(c.STAGES)
    ids = lambda df: sorted(((r.doc_id is None, r.doc_id or 0) for r in df.collect()))
    assert stage["quality rules"](spark, docs, sf).count() == 0  # too few words, or one word over and over
    lines = stage["line dedup"](spark, docs, sf)
    assert lines.columns == docs.columns and ids(lines) == ids(docs)
    left = {r.doc_id: r.text for r in lines.collect()}
    assert left[3] == left[5] == "" and left[7] == "one line of more than twenty characters" and left[1] is None
    near = stage["simhash near-dedup"](spark, docs, sf)
    assert near.columns == docs.columns and (True, 0) in ids(near) and len(ids(near)) == len(set(ids(near)))
    mixed = stage["mixing"](spark, docs, sf)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(docs)) and ids(mixed).count((False, 3)) % 2 == 0
    tokens = stage["byte bpe"](spark, docs, sf)
    assert ids(tokens) == ids(docs) and {r.n_tokens for r in tokens.collect() if r.doc_id in (1, 2)} == {0} and tokens.columns[: len(docs.columns) - 1] == [x for x in docs.columns if x != "text"]
