"""Components, the embedding join and the pipeline."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from sparkernels.llm import embeddings, mixing, quality
from sparkernels.llm.components import components


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5), (9, 3), (3, 9), (3, 7), (20, 21)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots(60, links)
    assert got == {n: want[n] for n in {x for a, b in links if a != b for x in (a, b)} if want[n] != n}


@pytest.mark.parametrize("cell,block", [(2048, 1024), (40, 16)])
def test_embedding_join_against_all_pairs(spark, cell, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12))
    x = np.concatenate([c + rng.normal(size=(12, 12)) * 0.15 for c in centres])
    labels = rng.integers(0, 2, 30).repeat(12)
    rows = [(i, [float(v) for v in np.float32(x[i])], int(labels[i])) for i in range(len(x))] + [(1000 + i, [float(v) for v in np.float32(x[0])], int(labels[0])) for i in range(20)]
    odd = [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [1.0], 1), (2003, [float("nan")] * 12, 1), (2004, [1.0] * 12, None), (2005, [], 1), (2006, [None] * 12, 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), cell=cell, block=block).collect()}
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    near = (y @ y.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(near, False)
    root = roots(len(rows), zip(*np.nonzero(near), strict=True))
    for k, (i, _, _) in enumerate(rows):
        least = min(rows[m][0] for m in range(len(rows)) if root[m] == root[k])
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(near[k].sum()), least, i == least)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i, _, _ in odd) and len(got) == len(rows) + len(odd)


def test_unlike_vectors_of_one_id_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 0, "a"), (1, [0.0, 1.0], 0, "b"), (2, [0.0, 1.0], 0, "c"), (3, [0.01, 1.0], 0, "d"), (0, [1.0, 0.01], 0, "e"), (5, [0.7, -0.7], 0, "f"), (5, [0.7, -0.7], 0, "f")]
    for clash in ("rep", "root"):
        got = embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label int, {clash} string")).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 1, 0), (1, 1, 0), (1, 2, 1), (2, 2, 1), (3, 2, 1), (5, 1, 5), (5, 1, 5)]
        if clash == "rep":
            assert sum(r.kept for r in got) == 4


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def test_each_stage_against_brute_force(spark, sf_dir):
    """Every stage on its own input, each document judged by itself or against all others."""
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = [first]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held[-1], sf_dir)
        assert out.columns == first.columns
        held.append(spark.createDataFrame(out.collect(), first.schema))
    rows = [{r.doc_id: r for r in df.collect()} for df in held]
    model = quality.train(first, labels)
    assert set(rows[1]) == {i for i, r in rows[0].items() if model.score(r.text.encode()) >= quality.THRESHOLD}
    ids = sorted(rows[1])
    sets = [shingle_set(rows[1][i].text) for i in ids]
    root = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    assert set(rows[2]) == {ids[k] for k in range(len(ids)) if root[k] == k}
    asked = set().union(*(windows(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()))
    assert set(rows[3]) == {i for i, r in rows[2].items() if not windows(r.text) & asked}
    sizes, taken = {}, {}
    for r in rows[3].values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in held[4].collect():
        assert rows[3][r.doc_id] == r
        taken.setdefault(r.source, []).append(len(r.text.split()))
    targets = mixing.shared(sizes, mixing.cyclic_weights(list(sizes)))
    largest = max(len(r.text.split()) for r in rows[3].values())
    assert all(abs(sum(taken.get(s, [])) - t) <= largest for s, t in targets.items())
    coded = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last, start = sorted(corpus_pipeline.STAGES[-1][1](spark, held[4], sf_dir).collect(), key=lambda r: r.start), 0
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in held[4].collect())
    for r in last:
        want = [*coded.encode(rows[3][r.doc_id].text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_the_pipeline_runs_whole(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_of_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
