from conftest import rows
from pyspark.sql import functions as F

from graphloom.sources import modules

FILES = [
    ("/p/src/a.ts", "import { Foo, Bar as B } from './lib/foo';\nimport Def from '../other'\nconst q = require('./lib');\nimport { X } from 'react';\nimport { Gone } from './gone'\n"),
    ("/p/src/lib/foo.tsx", "export class Foo {}\nexport const Bar = 1;\n  const inner = 2;\nexport default function Def() {}\ntype T = X\n"),
    ("/p/src/lib/index.js", "export { Foo as Again, Bar } from './foo';\nexport { Lost } from './none'\nfunction q() {}\n"),
    ("/p/other.mjs", "export async function Def() {}\n"), ("/p/src/b.ts", "import type { Again, Lost } from './lib/index.js';\nimport { Foo } from \"./lib/foo.tsx\""), ("/p/c.ts", None), ("/p/src/lib/foo.cjs", ""),
]


def _files(spark, files=FILES):
    return spark.createDataFrame(files, "file_path string, text string")


def test_exports(spark):
    assert rows(modules.export_index(_files(spark)), "file_path", "name", "original", "source") == sorted([
        ("/p/src/a.ts", "q", "q", None), ("/p/src/lib/foo.tsx", "Foo", "Foo", None), ("/p/src/lib/foo.tsx", "Bar", "Bar", None), ("/p/src/lib/foo.tsx", "Def", "Def", None), ("/p/src/lib/foo.tsx", "T", "T", None),
        ("/p/src/lib/index.js", "Again", "Foo", "./foo"), ("/p/src/lib/index.js", "Bar", "Bar", "./foo"), ("/p/src/lib/index.js", "Lost", "Lost", "./none"), ("/p/src/lib/index.js", "q", "q", None), ("/p/other.mjs", "Def", "Def", None),
    ], key=repr)


def test_paths(spark):
    one = lambda a, b: spark.range(1).select(modules.joined_path(F.lit(a), F.lit(b))).first()[0]
    assert [one("/p/src", "./x/../y"), one("/p", "../../z"), one("p/q", "../r")] == ["/p/src/y", "/z", "p/r"]


def test_imports(spark):
    f = _files(spark)
    i = modules.imports_of(f)
    assert ("/p/src/a.ts", "Bar", "B", "./lib/foo") in rows(i) and ("/p/src/a.ts", "Def", "Def", "../other") in rows(i) and ("/p/src/a.ts", "q", "q", "./lib") in rows(i)
    assert rows(modules.resolve_modules(i, f), "file_path", "module", "target") == sorted([
        ("/p/src/a.ts", "./lib/foo", "/p/src/lib/foo.tsx"), ("/p/src/a.ts", "../other", "/p/other.mjs"), ("/p/src/a.ts", "./lib", "/p/src/lib/index.js"), ("/p/src/b.ts", "./lib/index.js", "/p/src/lib/index.js"), ("/p/src/b.ts", "./lib/foo.tsx", "/p/src/lib/foo.tsx"),
    ])
    assert rows(modules.resolve_imports(i, modules.export_index(f), f), "file_path", "local", "origin", "origin_name") == sorted([
        ("/p/src/a.ts", "Foo", "/p/src/lib/foo.tsx", "Foo"), ("/p/src/a.ts", "B", "/p/src/lib/foo.tsx", "Bar"), ("/p/src/a.ts", "Def", "/p/other.mjs", "Def"), ("/p/src/a.ts", "q", "/p/src/lib/index.js", "q"),
        ("/p/src/b.ts", "Again", "/p/src/lib/foo.tsx", "Foo"), ("/p/src/b.ts", "Lost", "/p/src/lib/index.js", "Lost"), ("/p/src/b.ts", "Foo", "/p/src/lib/foo.tsx", "Foo"),
    ])


def test_no_files(spark):
    f = _files(spark).limit(0)
    assert modules.resolve_imports(modules.imports_of(f), modules.export_index(f), f).count() == 0
