"""Small repositories with what must come out, worked out by hand from the rules."""

import zipfile

import pytest
from pyspark.sql import functions as F

from repograph import constants as K
from repograph.operators import assemble, build, contexts, hierarchy, resolve, summarize
from repograph.operators.graph import Graph
from repograph.sources import files as sources

REPOS = {
    "relative": {"pkg/__init__.py": "from .x import y\n", "pkg/x.py": "y = 1\n", "pkg/mod.py": "from .x import y\nfrom . import x\nfrom ..x import y\n"},
    "alias": {"m.py": "def f(): pass\n", "a.py": "from m import f\nfrom m import f as g\nimport m\ndef h(): f(); g(); m.f()\n"},
    "methods": {"a.py": "class A:\n    def m(self): self.n()\n    def n(self): m()\n"},
    "nesting": {"a.py": "def outer():\n    def inner(): pass\nclass C:\n    def meth(self):\n        def hidden(): g()\n"},
    "top": {"a.py": '"""doc"""\nx = 1\nx\n'},
    "jsx": {
        "App.jsx": "import Button from './Button'\nfunction help(){return 1}\nexport default function App(){help(); return <Button/>}\n",
        "Button.jsx": "export default function Button(){return <button/>}\n",
    },
    "inheritance": {"a.py": "class Base: pass\n", "b.py": "class Base: pass\n", "c.py": "class D(Base): pass\nclass E(pkg.Base): pass\n"},
    "broken": {"bad.py": "def (:\n", "e.py": "", "n.txt": "  \n", "latin.py": b"x = '\xe9'\n"},
    "big": {"a.txt": "x" * 6001, "b.css": "y" * 10001, "c.json": '{"k0": [1], ' + ", ".join(f'"k{i}": "{"v" * 250}"' for i in range(1, 31)) + "}"},
    "scripts": {
        "src/index.ts": "import {a} from './lib';\nimport b from '@/components/Card';\nimport c from 'react';\nimport d from './deep/thing.js';\nimport e from '~utils/x';\n",
        "src/lib/index.js": "export const a = 1\n",
        "src/components/Card.tsx": "export const Card = () => <div/>\n",
        "src/deep/thing.js": "x\n",
        "src/utils/x.js": "y\n",
    },
}


@pytest.fixture(scope="module")
def load(spark, tmp_path_factory):
    """The stored tables of a repository, parsed and built once for all tests."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    made = {}

    def get(name):
        if name not in made:
            folder = tmp_path_factory.mktemp(name)
            for path, text in REPOS[name].items():
                target = folder / "in" / path
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(text if isinstance(text, bytes) else text.encode())
            members = sources.classified(sources.folder_files(spark, str(folder / "in")))
            built = build.build(sources.parsed(members.where("accepted")).coalesce(1), "root.zip")
            made[name] = built.stored(str(folder / "out"))
        return made[name]

    yield get
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def repo(load, tmp_path_factory):
    """(graph, nodes in order, edges in order, collapsed edges in order) of a resolved repository."""
    made = {}

    def get(name):
        if name not in made:
            graph = resolve.resolved(load(name))
            path = str(tmp_path_factory.mktemp(name) / "edges")
            graph.edges.coalesce(1).write.parquet(path)
            graph = Graph(graph.nodes, graph.nodes.sparkSession.read.parquet(path))
            nodes = {r.id: r for r in graph.nodes.orderBy("seq").collect()}
            name_of = lambda i: nodes[i].file_path if nodes[i].node_type in ("FILE", "FOLDER") else nodes[i].name
            edges = [(name_of(r.source_id), r.type, name_of(r.target_id), r.label) for r in graph.edges.orderBy("seq").collect()]
            collapsed = [(name_of(r.source_id), r.type, name_of(r.target_id), r.label) for r in graph.collapsed.orderBy("pos").collect()]
            made[name] = graph, list(nodes.values()), edges, collapsed
        return made[name]

    return get


def of(edges, kind):
    return [(a, b, label) for a, t, b, label in edges if t == kind]


def test_relative_imports(repo):
    _, _, edges, collapsed = repo("relative")
    assert of(edges, "IMPORTS") == [
        ("pkg/__init__.py", "pkg/x.py", "from pkg.x import y"),
        ("pkg/mod.py", "pkg/mod.py", "from pkg.mod import x"),
        ("pkg/mod.py", "pkg/x.py", "from pkg.x import y"),
    ]


def test_strict_relative_imports(load):
    labels = sorted(r.label for r in resolve.import_edges(load("relative"), strict=True).collect())
    assert labels == ["from pkg import x", "from pkg.x import y"]


def test_aliases_and_calls(repo):
    _, nodes, edges, collapsed = repo("alias")
    assert [n.name for n in nodes] == ["root.zip", "a.py", "Imports (L1-L3)", "h", "m.py", "f"]
    assert len(of(edges, "IMPORTS")) == 3 and of(collapsed, "IMPORTS") == [("a.py", "m.py", None)]
    assert of(edges, "CALLS") == [("h", "f", None)] * 2 and of(collapsed, "CALLS") == [("h", "f", None)]
    assert of(edges, "USES_IMPORT") == [("h", "m.py", None)]


def test_methods(repo):
    graph, nodes, edges, collapsed = repo("methods")
    assert of(edges, "CALLS") == [("n", "m", None)]
    assert ("m", "METHOD_OF", "A", None) in edges and ("m", "IS_PART_OF", "A", None) in collapsed and ("m", "METHOD_OF", "A", None) not in collapsed
    row = contexts.class_context(graph).first()
    assert row.methods == ["`def m(self)`", "`def n(self)`"]
    rows = {r.name: r for r in contexts.function_context(graph).collect()}
    assert rows["m"].callers == ["`n` (FUNCTION in `a.py`)"] and rows["n"].callees == ["`m` (FUNCTION)"] and rows["m"].class_name == "A"


def test_nesting(repo):
    _, nodes, edges, _ = repo("nesting")
    assert [n.name for n in nodes] == ["root.zip", "a.py", "C", "meth", "outer", "inner"] and not of(edges, "CALLS")
    assert [n.depth for n in nodes] == [0, 1, 2, 3, 2, 2]


def test_top_level(repo):
    _, nodes, _, _ = repo("top")
    assert [n.name for n in nodes if n.node_type == "NON_FUNCTION_NON_CLASS"] == ["top_level_code_L1-L1", "top_level_code_L2-L2"]


def test_components(repo):
    graph, nodes, edges, _ = repo("jsx")
    kinds = {n.name: n.node_type for n in nodes}
    assert kinds["App"] == kinds["Button"] == "REACT_COMPONENT" and kinds["help"] == "FUNCTION"
    assert of(edges, "IMPORTS") == [("App.jsx", "Button.jsx", "*")] and of(edges, "RENDERS") == [("App", "Button", None)] and not of(edges, "CALLS")
    assert {r.name: r.callers for r in contexts.component_context(graph).collect()} == {"App": [], "Button": ["`App` (REACT_COMPONENT in `App.jsx`)"]}
    file = {r.name: r for r in contexts.file_context(graph).collect()}["App.jsx"]
    assert file.contained_classes == ["`App` (React Component)"] and file.contained_functions == ["`help`"] and file.imports_made == ["`Button`"]


def test_inheritance(repo):
    _, _, edges, _ = repo("inheritance")
    assert of(edges, "INHERITS_FROM") == [("D", "Base", None)] * 2


def test_broken_files(repo):
    _, nodes, _, _ = repo("broken")
    assert [(n.name, n.node_type) for n in nodes] == [("root.zip", "FOLDER"), ("bad.py", "FILE"), ("e.py", "FILE"), ("latin.py", "FILE"), ("n.txt", "TEXT_FILE")]
    assert nodes[-1].raw_content == K.EMPTY_FILE


def test_big_files(repo):
    _, nodes, _, _ = repo("big")
    text, css, js = (n.raw_content for n in nodes[1:])
    assert text == "x" * 6000 + "\n\n... (truncated — 6001 total chars)" and css == "y" * 10000 + "\n\n... (truncated — 10001 total chars)"
    assert js.startswith('{\n  "k0": array[1 items],\n  "k1": str,\n') and "  ... (1 more top-level keys)\n}  // " in js


def test_script_modules(repo):
    _, _, edges, _ = repo("scripts")
    assert of(edges, "IMPORTS") == [
        ("src/index.ts", "src/lib/index.js", "*"),
        ("src/index.ts", "src/components/Card.tsx", "*"),
        ("src/index.ts", "src/deep/thing.js", "*"),
        ("src/index.ts", "src/utils/x.js", "*"),
    ]


def test_document(repo):
    graph, _, _, _ = repo("methods")
    text = assemble.assemble(graph.nodes, 6).first().document
    assert text.startswith("## Folder: root.zip\n\n- **Path:** `.`\n**Summary:** (Not available)\n\n### File: a.py\n\n- **Module Path:** `a`\n")
    assert text.index("#### Class: A") < text.index("##### Method: m\n\n- **Access:** `public`\n**Signature:**\n```python\ndef m(self)\n```\n\n") < text.index("##### Method: n")
    assert assemble.assemble(graph.nodes.limit(0), 3).first().document == K.NO_ROOTS


def test_tree_properties(repo):
    for name in ("relative", "scripts"):
        graph, nodes, edges, collapsed = repo(name)
        assert graph.dangling().count() == 0
        by_id = {n.id: n for n in nodes}
        assert len(by_id) == len(nodes) and all(n.belongs_to is None or by_id[n.belongs_to].depth < n.depth for n in nodes)
        assert {(a, b) for a, _, b, _ in collapsed} == {(a, b) for a, _, b, _ in edges}


def test_archive(spark, tmp_path):
    keep = ["sub/venv/x.py", "sub/.env.json", "sub/package-lock.json", "p/__pycache__/a.py", "x/.git/config.json", "src/app.py", "README.md", "Dockerfile"]
    leave = ["venv/lib/x.py", "a.min.js", "sub/a.min.js", ".hidden/x.py", "package-lock.json", "__pycache__/a.py", "p/a.pyc", ".git/config.json", "notes.LOG", "../evil.py"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for path in keep + leave:
            z.writestr(path, "x = 1\n")
        z.writestr("dir/", "")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = sources.classified(sources.zip_members(spark, str(tmp_path)))
    got = rows.where("accepted").select("path").collect()
    assert sorted(r.path for r in got) == sorted(keep)
    counts = sources.extraction_counts(rows.where("path IS NOT NULL")).first()
    assert (counts.python_files, counts.config_files, counts.unsupported_files) == (3, 5, 1)
    archives = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r.path.rsplit("/", 1)[-1]: r.fault for r in sources.upload_faults(archives, 10**6).collect()} == {"b.zip": "not an archive"}
    assert sources.upload_faults(archives, 5).count() == 2


def test_same_for_any_partitions(spark, load):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, resolve.call_edges(load("alias")).select("source_id", "target_id", "seq").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert seen[0] == seen[1] and len(seen[0]) == 2


def test_import_block(load, repo):
    row = contexts.import_block_context(repo("alias")[0], load("alias").imports).first()
    assert row.statements == ["from m import f", "from m import f as g", "import m"]


def test_summaries(spark, load, repo, tmp_path):
    graph = repo("methods")[0]

    def keep(df, name):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    done = summarize.summarise(graph, load("methods").imports, 3, keep=keep).nodes
    by = {r.name: r.summary for r in done.collect()}
    assert by["m"] == "Explain what this function does, its parameters and its result. File: a.py"
    assert by["root.zip"].startswith("Summarise this folder") and set(by) == {"root.zip", "a.py", "A", "m", "n"}
    assert [(r.ok, r.failed) for r in summarize.level_counts(done).where("depth IS NULL").collect()] == [(5, 0)]
    with pytest.raises(ValueError):
        summarize.summarizer("none")


def test_projects_stay_apart(spark, tmp_path):
    """Two archives with equal paths: two graphs, and no edge between them."""
    for name in ("one", "two"):
        (tmp_path / "in").mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / "in" / f"{name}.zip", "w") as z:
            z.writestr("src/main.py", "from src.lib import f\nclass D(Base): pass\ndef g(): f()\n")
            z.writestr("src/lib.py", f"class Base: pass\ndef f(): pass\ndef {name}(): pass\n")
            z.writestr("src/App.jsx", "import Button from '@/src/Button'\nexport default function App(){return <Button/>}\n")
            z.writestr("src/Button.jsx", "export default function Button(){return <button/>}\n")
    members = sources.classified(sources.zip_members(spark, str(tmp_path / "in")))
    built = build.build(sources.parsed(members.where("accepted")).coalesce(1)).stored(str(tmp_path / "out"))
    nodes = {r.id: r for r in built.graph.nodes.collect()}
    assert len(nodes) == built.graph.nodes.count()
    by_project = {}
    for r in nodes.values():
        by_project.setdefault(r.project, []).append((r.node_type, r.name, r.file_path))
    one, two = (by_project[p] for p in sorted(by_project))
    assert {x for x in one if x[1] not in ("one", "one.zip")} == {x for x in two if x[1] not in ("two", "two.zip")}
    assert ("FOLDER", "one.zip", ".") in one and ("FOLDER", "two.zip", ".") in two
    edges = resolve.resolved(built).edges.select("source_id", "target_id", "type").collect()
    assert all(nodes[e.source_id].project == nodes[e.target_id].project for e in edges)
    kinds = sorted(e.type for e in edges if nodes[e.source_id].project == sorted(by_project)[0] and e.type in ("IMPORTS", "CALLS", "INHERITS_FROM", "USES_IMPORT", "RENDERS"))
    assert kinds == ["CALLS", "IMPORTS", "IMPORTS", "INHERITS_FROM", "RENDERS", "USES_IMPORT"]


def test_endings_and_tags_take_the_first(spark, tmp_path):
    """Many files of one name, and many components: an ending takes the first in the walk's order, a tag the nearest."""
    files = {f"d{i}/index.js": "export const a = 1\n" for i in range(8)} | {f"d{i}/sub/index.js": "export const a = 1\n" for i in range(8)}
    files |= {f"d{i}/Card.jsx": "export default function Card(){return <p/>}\n" for i in range(8)}
    files |= {"a.js": "import x from '@/sub/index'\nimport y from '@/d5/index'\nimport z from '@/b/index'\n"}
    files |= {"App.jsx": "import Card from './d3/Card'\nexport default function App(){return <Card/>}\n", "Z.jsx": "export default function Z(){return <Card/>}\n"}
    for path, text in files.items():
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text(text)
    members = sources.classified(sources.folder_files(spark, str(tmp_path / "in")))
    built = build.build(sources.parsed(members.where("accepted")).coalesce(1)).stored(str(tmp_path / "out"))
    nodes = {r.id: r for r in built.graph.nodes.collect()}
    edges = resolve.resolved(built).edges.orderBy("seq").collect()
    path = lambda i: nodes[i].file_path
    # nothing ends with b/index but sub/index, whose first is d0's
    assert [(path(e.target_id), e.label) for e in edges if e.type == "IMPORTS" and path(e.source_id) == "a.js"] == [("d0/sub/index.js", "*"), ("d5/index.js", "*"), ("d0/sub/index.js", "*")]
    assert sorted((path(e.source_id), path(e.target_id)) for e in edges if e.type == "RENDERS") == [("App.jsx", "d3/Card.jsx"), ("Z.jsx", "d0/Card.jsx")]


def test_deep_trees(spark):
    """A chain of 40 levels and a cycle: plans stay small, and nothing is lost but what hangs on no root."""
    rows = [(f"n{i}", f"n{i - 1}" if i else None, i) for i in range(41)] + [("c1", "c2", 1), ("c2", "c1", 1), ("lost", "nowhere", 2)]
    nodes = spark.createDataFrame(rows, "id string, belongs_to string, depth int")
    walked = {r.id: (r.level, r.sort_key) for r in hierarchy.descend(nodes, lambda _: F.col("id")).collect()}
    assert walked == {f"n{i}": (i, [f"n{k}" for k in range(i + 1)]) for i in range(41)}
    counts = hierarchy.bottom_up(nodes, F.lit(1).cast("long"), F.sum)
    assert len(counts._jdf.queryExecution().logical().toString()) < 200_000
    got = {r.id: r.value for r in counts.collect()}
    assert {i: got[f"n{i}"] for i in range(41)} == {i: 41 - i for i in range(41)} and got["lost"] == 1 and got["c1"] == 2
