"""Typed entities, relations and chunks on small texts."""

import pytest

from codeloom.sources import structures as S

SCRIPT = """import a, { b as c } from './a';
import './side';
const x = require("y"); // require('no')
export default class A extends B.C implements D<E, F>, G {
  #n = 1;
  async m(p = {}) { if (p) { throw new Oops('class Z {'); } }
  get v(): number { return 1 }
}
export async function* f(a) { function inner() {} }
export const g = async (a, b) => a, { h, i: j, ...k } = f();
let [l, [n]] = x;
interface I extends J { q(): void }
export type T = string;
const enum K { One }
/* class Hidden {} */
const data = JSON.parse(fs.readFileSync('conf/a.json'));
"""


def _files(spark, *texts):
    return spark.createDataFrame([*enumerate(texts), (99, None)], "file_id bigint, content string")


def test_script_entities(spark):
    got = {(r["kind"], r["name"], r["owner"], r["start_line"], r["exported"]) for r in S.script_entities(_files(spark, SCRIPT, "")).collect()}
    assert {("class", "A", None, 4, True), ("method", "m", "A", 6, False), ("method", "v", "A", 7, False), ("function", "f", None, 9, True), ("function", "g", None, 10, True)} <= got
    assert {("variable", "l", None, 11, False), ("variable", "n", None, 11, False), ("interface", "I", None, 12, False), ("type", "T", None, 13, True), ("enum", "K", None, 14, False), ("variable", "data", None, 16, False)} <= got
    assert not {"Hidden", "Z", "if", "q"} & {x[1] for x in got}
    ends = {r["name"]: r["end_line"] for r in S.script_entities(_files(spark, SCRIPT)).where("kind = 'class'").collect()}
    assert ends == {"A": 8}
    assert S._bound("{ h, i: j, ...k, o: { p = 2 } }") == ["h", "j", "k", "p"]


def test_script_relations(spark):
    got = {(r["kind"], r["source"], r["target"], r["line_no"]) for r in S.script_relations(_files(spark, SCRIPT)).collect()}
    assert got == {("imports", None, "./a", 1), ("imports", None, "./side", 2), ("requires", None, "y", 3), ("extends", "A", "B.C", 4), ("implements", "A", "D", 4), ("implements", "A", "G", 4), ("throws", None, "Oops", 6), ("extends", "I", "J", 12), ("loads", None, "conf/a.json", 16)}


def test_json(spark):
    files = _files(spark, '{"a": {"b c": [1, {"d": null}]}, "e": true}', "[1", '{"items": [{"title": "T", "body": "B"}, 3, {"id": 7}]}', '[{"name": "n"}]')
    got = {(r["path"], r["kind"], r["depth"]) for r in S.json_structure(files).where("file_id = 0").collect()}
    assert got == {("$.a", "object", 1), ('$.a."b c"', "array", 2), ('$.a."b c"[1].d', "null", 4), ("$.e", "boolean", 1)}
    items = {(r["file_id"], r["path"], r["i"], r["title"], r["body"]) for r in S.json_items(files).collect()}
    assert items == {(2, "$.items", 0, "T", "B"), (2, "$.items", 2, "7", None), (3, "$", 0, "n", None)}


YAML = """on: push
jobs:
  build:
    steps:
      - uses: a/b@v1
      - run: |
          key: not one
          more
      - name: x
  test: {}
# c: d
"""


def test_yaml(spark):
    got = {(r["kind"], r["path"], r["line_no"]) for r in S.yaml_entities(_files(spark, YAML)).collect()}
    assert got == {("key", "on", 1), ("key", "jobs", 2), ("job", "jobs.build", 3), ("key", "jobs.build.steps", 4), ("step", "jobs.build.steps.uses", 5), ("step", "jobs.build.steps.run", 6), ("key", "jobs.build.steps.name", 9), ("job", "jobs.test", 10)}
    assert S.yaml_kind("version: '3'\nservices:\n  a:\n    image: x\n") == "compose" and S.yaml_kind("apiVersion: v1\nkind: Pod\n") == "kubernetes" and S.yaml_kind("a: 1\n") == "generic"
    assert {(r["kind"], r["name"]) for r in S.yaml_entities(_files(spark, "apiVersion: v1\nkind: Pod\n")).collect()} == {("key", "apiVersion"), ("resource", "Pod")}


PYTHON = """class A(B):
    @deco(1)
    def f(self, a, *b):
        \"\"\"Does it.

        More.\"\"\"
        try:
            return self.g(len(a))
        except (KeyError, E):
            raise Other("x") from None

async def h():
    if x and y:
        yield 1
"""


def test_implementation_chunks(spark):
    got = {r["name"]: r for r in S.implementation_chunks(_files(spark, PYTHON, "def (")).collect()}
    assert set(got) == {"A", "A.f", "h"}
    f = got["A.f"]
    assert (f["kind"], f["start_line"], f["end_line"], f["calls"], f["raises"], f["handles"], f["complexity"]) == ("method", 2, 10, ["Other", "deco", "g"], ["Other"], ["E", "KeyError"], 2)
    assert f["content"] == "\n".join(PYTHON.split("\n")[1:10])
    assert f["observations"] == ["Purpose: Does it.", "Calls: Other, deco, g", "Raises: Other", "Handles: E, KeyError", "Decorators: deco(1)", "Parameters: self, a, b", "Returns a value"]
    assert got["A"]["observations"][-2:] == ["Inherits: B", "Methods: f"] and {"Asynchronous", "Generator"} <= set(got["h"]["observations"]) and got["h"]["complexity"] == 3


def test_internal_imports(spark):
    files = spark.createDataFrame([("r", "./pkg/__init__.py"), ("r", "pkg/a.py"), ("q", "x.py"), ("r", None)], "repo string, file_path string")
    imports = spark.createDataFrame([(1, "r", "pkg.a"), (1, "r", "pkg"), (1, "r", ".b"), (1, "r", "x"), (1, "r", "os"), (2, "q", "x"), (2, None, "x")], "file_id bigint, repo string, module string")
    got = {(r["repo"], r["module"]): r["is_internal"] for r in S.internal_imports(imports, files).collect()}
    assert got == {("r", "pkg.a"): True, ("r", "pkg"): True, ("r", ".b"): True, ("r", "x"): False, ("r", "os"): False, ("q", "x"): True, (None, "x"): False}


@pytest.mark.parametrize("fn", [S.script_entities, S.script_relations, S.json_structure, S.json_items, S.yaml_entities, S.implementation_chunks])
def test_empty_tables_and_texts(spark, fn):
    assert fn(_files(spark)).count() == 0 and fn(_files(spark, "", "\x00 { [ `")).count() == 0
