"""The whole way from a folder to answers."""

from codelode.api import Corpus
from codelode.operators import summary


def test_corpus(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in (
        ("README.md", "# Zoo\n\nAnimals and keepers live here together.\n\n## Usage\n\nCall it:\n\n```python\nfeed()\n```\n\n## Install\n\npip install zoo\n"), ("docs/guide.md", "# Guide\n\nUnderstanding the zoo."),
        ("zoo/animal.py", "class Animal:\n    def eat(self):\n        return chew()\n\ndef chew():\n    return 1\n"), ("zoo/cat.py", "from zoo.animal import Animal\n\nclass Cat(Animal):\n    def purr(self):\n        return self.eat()\n"),
    ):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    c = Corpus.index(spark, str(root), "zoo")
    assert c.health()["status"] == "degraded" and c.list().count() == 1 and c.search("zoo").first().score == 1.0
    assert {r.name for r in c.find_symbols(kind="class").collect()} == {"Animal", "Cat"}
    assert c.symbol("Cat").first().bases == ["Animal"]
    assert c.docs("zoo", "usage of animals", max_tokens=500).first().title in ("Zoo", "Guide")
    assert c.find_documents("understanding").first().path == "docs/guide.md"
    assert [tuple(r) for r in c.graph("class").edges.select("source", "target", "relation").collect()] == [("zoo/cat.py:Cat", "zoo/animal.py:Animal", "inherits")]
    assert {r.level for r in c.layers().collect()} == {0, 1} and c.cycles().count() == 0 and c.metrics().first().grade == "A"
    # dotted names are modules outside for the file graph; the dump's graph leads to their files
    assert [tuple(r) for r in c.graph("file").edges.select("source", "target").collect()] == [("zoo/cat.py", "zoo.animal")]
    assert [tuple(r) for r in c.graph("dump").edges.select("source", "target").collect()] == [("zoo/cat.py", "zoo/animal.py")]
    assert {r.id.split(":")[1] for r in c.call_graph("eat").collect()} == {"Animal.eat", "chew"}
    assert c.query("MATCH (n:Class) RETURN count(n)").first()[0] == 2
    assert "Cat" in c.export().first().text and c.dsm().count() == 1 and c.analyze().count() > 3
    assert c.full_text("cat").count() >= 1
    assert c.llmstxt("zoo").first().text.startswith("# Zoo\n\n> Animals and keepers live here together.")
    assert c.chunks().count() > 2 and c.enriched().count() == 2
    assert "index" in c.dump(str(tmp_path / "out"))
    assert {k for k in c.architecture()} == {"metrics", "cycles", "layers", "violations", "hotspots", "suggestions"}
    s = summary.snippets_with_context(c.documents).collect()
    assert [(r.language, r.code, r.context) for r in s] == [("python", "feed()", "## Usage\nCall it:")]
    text = c.documents.where("path = 'README.md'").select(summary.readme_summary(c.documents.content).alias("s")).first().s
    assert "Animals" in text and "pip install" not in text and "feed" not in text


def test_repaired_json():
    assert summary.repaired_json('Sure: ```json\n{"a": [1, 2,], "b": "x,]"}\n```') == {"a": [1, 2], "b": "x,]"}
    assert summary.repaired_json('{"a": [1, 2') == {"a": [1, 2]} and summary.repaired_json("none") is None
