import json
import shutil
from pathlib import Path

import pytest

from loreweave import cli
from loreweave.diagnostics import EvaluationLoadError, SnapshotLoadError, StoredIndexError, VectorIndexError, diagnostic_code
from loreweave.operators import hybrid
from loreweave.operators.embedding import EmbeddingConfig, HashEmbedder, VectorIndexConfig, checked, embed_column
from loreweave.operators.graph import GraphExpansionConfig
from loreweave.sources import knowledge, store

KB = Path(__file__).parent / "fixtures" / "kb"


def load(spark, root=KB):
    return knowledge.load_snapshot(spark, root / "content", root / "graph.json", root / "references.yml", root / "evals.yml")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    manifest = store.build_index(spark, load(spark), path)
    return path, manifest


def test_snapshot(spark, rows):
    s = load(spark)
    assert rows(s.entities, "entity_path", "entity_type", "source_ids_json", "metadata_json", "timestamp") == [
        ("/notes/kyoto.md", "Note", "[]", "{}", "2026-01-01"),
        ("/people/ada.md", "Person", '["book"]', "{}", "2026-01-01T00:00:00Z"),
        ("/people/ben.md", "Person", '["bare"]', '{"color":"green"}', "2026-01-02T00:00:00+02:00"),
    ]
    assert rows(s.relations, "source_path", "predicate", "target", "confidence", "owner_source_ids_json") == [("/people/ada.md", "teaches", "/people/ben.md", "C", '["book"]')]
    assert rows(s.claims, "claim_path", "property", "value_json") == [("/claims/teaching.md", None, None), ("/claims/year.md", "founded-year", '"1900"')]
    assert rows(s.kb_references, "reference_id", "year", "authors_json") == [("bare", None, "[]"), ("book", None, '["An Author"]'), ("web", 1999, '["A","B"]')]


@pytest.mark.parametrize(
    "file,old,new",
    [
        ("content/people/ada.md", "confidence: C", "confidence: B"),
        ("content/people/ada.md", "tags: [fixture]\n", ""),
        ("content/people/ada.md", "title: Ada Source", "title: ''"),
        ("content/people/ada.md", "---\n\n# Bio", "\n\n# Bio"),
        ("content/claims/year.md", "sources: [bare]", "sources: []"),
        ("content/claims/year.md", "value:", "object:"),
        ("graph.json", '"claims"', '"other"'),
        ("graph.json", "The person that learns.", "Other."),
        ("graph.json", '"confidence": "A"', '"confidence": "B"'),
        ("references.yml", ", url: \"https://example.test/page\"", ""),
        ("references.yml", 'year: "1999"', "year: nineteen"),
    ],
)
def test_inconsistent_sources(spark, tmp_path, file, old, new):
    shutil.copytree(KB, tmp_path / "kb")
    path = tmp_path / "kb" / file
    assert old in path.read_text()
    path.write_text(path.read_text().replace(old, new, 1))
    with pytest.raises(SnapshotLoadError) as e:
        load(spark, tmp_path / "kb")
    assert diagnostic_code(e.value) == "snapshot_load_error"


def test_cases(tmp_path):
    assert knowledge.load_cases(KB / "evals.yml")[0]["expected_json"] == '["/people/ada.md","/people/ben.md"]'
    for text in ("[]", "a: 1", "- {id: a, query: q}", "- {id: a, query: q, expected: x, evidence: [/a]}\n- {id: a, query: q, expected: x, evidence: [/a]}", "- {id: a, case_id: b, query: q, expected: x, evidence: []}"):
        (tmp_path / "e.yml").write_text(text)
        with pytest.raises(EvaluationLoadError):
            knowledge.load_cases(tmp_path / "e.yml")


def ask(spark, index, text, **config):
    q = spark.createDataFrame([("q", text)], "query_id string, query_text string")
    return [(r.entity_path, r.retriever, round(r.score, 6), r["rank"]) for r in hybrid.search(q, index, hybrid.RetrievalConfig(**config)).orderBy("rank").collect()]


def test_lexical_scores_and_expansion(spark, built):
    index = store.open_index(spark, built[0])
    assert ask(spark, index, "ＴＥＡＣＨＥＳ", top_k=1) == [("/people/ada.md", "lexical.chunk", 6.0, 1)]
    assert ask(spark, index, "宮城長順")[0] == ("/notes/kyoto.md", "lexical.chunk", 13.5, 1) or ask(spark, index, "宮城長順")[0][0] == "/notes/kyoto.md"
    assert ask(spark, index, "  ") == []
    got = ask(spark, index, "teaches", top_k=5, graph=GraphExpansionConfig(enabled=True))
    scores = {(p, s) for p, r, s, _ in got if r == "graph.one-hop"}
    assert ("/people/ben.md", 2.25) in scores and ("/people/ada.md", 4.5) in scores and ("/people/ben.md", 0.5625) in scores
    assert hybrid.RetrievalConfig(top_k=5, graph=GraphExpansionConfig(enabled=True)).cutoffs() == {"lexical.passage": 20}


def test_vectors_and_hybrid(spark, built, tmp_path):
    index = store.open_index(spark, built[0])
    config = VectorIndexConfig(EmbeddingConfig("hash-embedder", "sha256", 8))
    embedder = HashEmbedder(config.embedding)
    vectors = embed_column(index.tables["chunks"], ["chunk_id", "content_hash"], "text", embedder, "document")
    store.build_vectors(spark, vectors, str(tmp_path), config, index)
    stored, manifest, own = store.open_vectors(spark, str(tmp_path), index)
    assert own == config and manifest["counts"] == {"vectors": 3}
    q = spark.createDataFrame([("q", "Ada Source teaches")], "query_id string, query_text string")
    for mode in ("vector", "hybrid"):
        hits = hybrid.search(q, index, hybrid.RetrievalConfig(mode), stored, embedder).collect()
        assert sorted(h["rank"] for h in hits) == list(range(1, len(hits) + 1)) and len({h.entity_path for h in hits}) == 3
    with pytest.raises(VectorIndexError):
        store.build_vectors(spark, vectors.union(vectors), str(tmp_path), config, index)
    with pytest.raises(ValueError):
        checked([[1.0, float("nan")]], 1, 2)
    assert embedder.embed(["a"], "query") != embedder.embed(["a"], "document")


def test_rebuild_and_damage(spark, built, tmp_path):
    path, manifest = built
    assert not store.needs_rebuild(spark, load(spark), path)
    shutil.copytree(KB, tmp_path / "kb")
    p = tmp_path / "kb/content/people/ben.md"
    p.write_text((KB / "content/people/ben.md").read_text().replace("Ben Target learns.", "Ben Target learns more."))
    assert store.needs_rebuild(spark, load(spark, tmp_path / "kb"), path)
    copy = tmp_path / "copy"
    store.build_index(spark, load(spark), str(copy))
    old = (copy / "CURRENT").read_text()
    with pytest.raises(ValueError):
        store.build_index(spark, load(spark), str(copy), 0)
    assert (copy / "CURRENT").read_text() == old and store.open_index(spark, str(copy)).manifest["counts"]["entities"] == 3
    shutil.rmtree(Path(old.removeprefix("file:")) / "chunks.parquet")
    with pytest.raises(StoredIndexError):
        store.open_index(spark, str(copy))
    with pytest.raises(StoredIndexError):
        store.open_index(spark, str(tmp_path / "none"))


def test_command_line(spark, tmp_path, capsys):
    def call(*args):
        code = cli.main(list(args), spark)
        out, err = capsys.readouterr()
        return code, json.loads(out or err)

    index, vectors = str(tmp_path / "i"), str(tmp_path / "v")
    build = ["build", "--content-root", str(KB / "content"), "--graph", str(KB / "graph.json"), "--references", str(KB / "references.yml"), "--eval", str(KB / "evals.yml"), "--index", index]
    code, out = call(*build)
    assert code == 0 and set(out) == {"command", "index", "manifest", "schema_version"}
    assert call("vector-build", "--index", index, "--vector-index", vectors)[0] == 0
    code, out = call("search", "teaches", "--index", index)
    assert code == 0 and set(out) == {"command", "query", "results", "schema_version"} and out["results"][0]["entity_path"] == "/people/ada.md"
    code, out = call("context", "teaches", "--index", index, "--expand-graph")
    assert code == 0 and set(out) == {"command", "packets", "query", "schema_version"} and all(r["resolved"] for p in out["packets"] for r in p["references"])
    code, out = call("inspect", "/people/ada.md", "--index", index)
    assert set(out) == {"chunks", "command", "entity", "schema_version"} and out["chunks"][0]["chunk_id"] == "/people/ada.md#Biography"
    for mode in (["--mode", "lexical"], ["--mode", "hybrid", "--vector-index", vectors]):
        code, out = call("eval", "--index", index, *mode)
        assert (code, out["recall_at_k"], out["mrr"], out["by_kind"]["relation"]["count"]) == (0, 1.0, 1.0, 1)
    assert out["fusion_config"]["rrf"]["constant"] == 60.0
    for bad, name in ((["search", "x", "--index", str(tmp_path / "no")], "sqlite_index_error"), (["search"], "usage_error"), (["inspect", "/no", "--index", index], "invalid_input"), (["search", "x", "--mode", "vector", "--index", index], "usage_error")):
        code, out = call(*bad)
        assert code == 2 and set(out) == {"error", "schema_version"} and out["error"]["code"] == name
    assert cli.migrate({"a": 1})["schema_version"] == 1
    with pytest.raises(ValueError):
        cli.migrate({"schema_version": 9})


def test_embedders_are_held_to_their_contract():
    from loreweave.diagnostics import EmbeddingError
    from loreweave.operators.embedding import EmbeddingConfig, InjectedEmbedder, embedded

    config = EmbeddingConfig("own", "m", 2)
    make = lambda f: InjectedEmbedder(config, f, f)
    good = make(lambda texts: [(t, [1.0, 2.0]) for t in texts])
    assert embedded(good, ["a", "b"], "document", ["a", "b"]) == [[1.0, 2.0]] * 2 and embedded(make(None), [], "document") == []
    for wrong in (lambda t: [(x, [1.0, 2.0]) for x in reversed(t)], lambda t: [(t[0], [1.0, 2.0])] * 2, lambda t: [[1.0, 2.0]], lambda t: [[1.0]] * 2, lambda t: [[1.0, float("nan")]] * 2, lambda t: [[True, 1.0]] * 2, lambda t: ["ab"] * 2):
        with pytest.raises(EmbeddingError):
            embedded(make(wrong), ["a", "b"], "document", ["a", "b"])
    cause = OSError("gone")

    def fails(texts):
        raise cause

    with pytest.raises(EmbeddingError) as e:
        embedded(make(fails), ["a"], "query")
    assert e.value.__cause__ is cause


def test_graphs_of_wrong_shape(spark, tmp_path):
    import json

    from loreweave.diagnostics import SnapshotLoadError
    from loreweave.sources.knowledge import graph_tables

    def load(value):
        (tmp_path / "g.json").write_text(value if isinstance(value, str) else json.dumps(value, indent=1), encoding="utf-8-sig")
        return graph_tables(spark, tmp_path / "g.json")

    whole = {"nodes": [{"path": "/a", "type": "T", "title": "é", "tags": ["x"]}], "edges": [{"source": "/a", "predicate": "p", "target": "/b"}], "claims": [], "views": [], "predicates": {"p": {"n": 1}}}
    nodes, relations, claims = load(whole)
    assert [tuple(r) for r in nodes.collect()] == [("/a", "T", "é", None, '["x"]')] and relations.first().target == "/b" and claims.count() == 0
    for wrong in ("[]", "nothing", {}, {**whole, "more": []}, {k: v for k, v in whole.items() if k != "claims"}, {**whole, "nodes": {}}, {**whole, "views": {}}, {**whole, "predicates": []}, {**whole, "nodes": [{"path": "/a"}]}, {**whole, "edges": [{"source": "/a"}]}):
        with pytest.raises(SnapshotLoadError):
            load(wrong)


def test_public_names_and_codes():
    import loreweave
    from loreweave import diagnostics

    assert len(loreweave.__all__) > 80 and all(getattr(loreweave, n) is not None for n in loreweave.__all__)
    codes = {e.code for e in vars(diagnostics).values() if isinstance(e, type) and hasattr(e, "code")}
    assert {"fusion_error", "evaluation_error", "vector_retrieval_error", "sqlite_index_error", "vector_sidecar_error", "embedding_provider_error"} <= codes
    with pytest.raises(AttributeError):
        loreweave.nothing  # noqa: B018
