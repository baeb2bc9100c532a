import pytest
from conftest import rows

from graphloom.llm.syntax import fault, fault_rates, parse_faults

GOOD = {
    "kt": [
        'package a.b\n\nimport a.c.*\n\ndata class X(private val a: Int, val b: List<String?> = listOf()) : Y(a), Z {\n  fun f(x: Int) = x to 3\n  val s = "it\'s ${a + "n { $b"} {"\n  /* a /* nested */ ( */\n  val r = """raw " { ${a} """\n  val c = \'{\'\n}\n',
        "fun main() {\n  for (i in 0 until 10 step 2) println(i shl 1)\n  if (a !is B) return else throw C()\n}\n", "", "// only <<<<<<< a comment\n",
    ],
    "java": [
        'package a.b;\nimport static a.C.*;\npublic final class X<T extends Y> extends Z implements W {\n  private int[] a = {1, 2};\n  String s = "(" + \'"\' + """\n  text " { block\n  """;\n  @Override public T f(final int x) throws E { return x > 0 ? a(x) : b -> c; }\n}\n',
    ],
    "ts": [
        "import { A, type B } from './a';\nexport abstract class X<T> extends Y implements Z {\n  constructor(private readonly a: A, public b?: B) { super(); }\n  @Input() name!: string;\n  get x(): number { return `a ${this.b ? `}` : '{'} b`.length / 2; }\n}\nconst r = /[{(\"']+/g.test(s);\n",
        "declare module 'x' {\n  export interface Y { readonly z: string }\n}\n",
    ],
    "js": [
        "'use strict';\nconst a = require('./a');\nexport default class X { static async *f(x = {a: 1}) { return x ? a : /=\\/(/.test(b); } }\nlabel: for (const k of [1, 2]) { switch (k) { case 1: break; default: } }\nvar s = 'don\\'t {';\n",
        "#!/usr/bin/env node\nconst as = 1, from = 2;\nimport x from 'y';\nexport { x as z };\n", "!function(e,t){e.a=[1,2];t.b=function(k){return k?e.c:9}}(this,0);",
    ],
}
BAD = {
    "kt": ["class X {\n  fun f() {\n", "class X { ]\n", 'val s = "open\n', "/* open\nval x = 1\n", "a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n", "def f(x):\n    return x\n", "<!DOCTYPE html>\n<html></html>", "# Title\n\nSome words\n", "package a.b;\npublic class X {\n  private final int a = 1;\n}\n", "import { A } from 'x'\n"],
    "java": ["package a.b\n\nimport a.C\n\nclass X(private val a: Int)\n", "class X { void f() { int x = = 3; } }\n", "class X { String s = \"open;\n }\n", "class X {\n  int f() { return 1 }\n", "import a.b.C;\nclass X {}\nfoo("],
    "ts": ["package a.b\nclass X\n", "export class X {\n  f() { return `open ${a} ; }\n}\n", "const x = [1, 2);\n", "def f(x):\n    pass\n"],
    "js": ["export class X {\n  constructor(private readonly a: A) {}\n}\n", "function f(a: string): number { return 1; }\n", "interface X { a: string }\n", "const a: number = 1;\n", "foo(…"],
}


@pytest.mark.parametrize(("ending", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ending, text):
    assert fault(text, ending) is None


@pytest.mark.parametrize(("ending", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid(ending, text):
    assert fault(text, ending)


def test_very_long_text():
    assert fault("val x = 1\n" * 200_000, "kt") is None
    assert fault("class A {\n" + "val x = 1\n" * 200_000, "kt") == "premature end"


def test_per_file_and_rates(spark):
    docs = [(1, "fun f() {}", "/p/A.kt", "/p"), (2, "fun f() {", "/p/B.kt", "/p"), (3, None, "/p/c.ts", "/p"), (4, "{", "/p/readme.md", "/p"), (5, "{", None, "/p"), (6, "class X {", "/q/D.JAVA", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, file_path string, project_path string")
    assert rows(parse_faults(d), "doc_id", "fault") == [(1, None), (2, "premature end"), (3, None), (6, "premature end")]
    e = spark.createDataFrame([("/p/B.kt",), ("/p/B.kt",), ("/gone.kt",), (None,)], "file_path string")
    assert rows(fault_rates(d, e), "project_path", "language", "n_files", "n_invalid", "n_reported") == [("/p", "kotlin", 2, 1, 1), ("/p", "typescript", 1, 0, 0), (None, "java", 1, 1, 0)]
    assert parse_faults(d.limit(0)).count() == 0
