"""Units of brace languages, against what a reader of each snippet expects."""

import pytest

from polyvec.operators.units import file_units, skip_reason

SNIPPETS = {
    'a.js': 'import {x} from "./lib/helper";\n// Adds two.\nexport function add(a, b = 2) {\n  if (a) { return helper.plus(a, b); }\n  return "{ not a brace" + b;\n}\n\nconst LIMIT = 3;\nconst twice = (v) => {\n  return add(v, v);\n};\nclass Stack extends Base {\n  constructor(items) {\n    this.items = items;\n  }\n  push(item) {\n    for (const x of item) { this.items.push(x); }\n  }\n}\nrun();\n',
    'a.go': 'package main\n\nimport "fmt"\n\nconst Max = 10\n\ntype Stack struct {\n\titems []int\n}\n\n// Push adds.\nfunc (s *Stack) Push(x int) {\n\tif x > 0 {\n\t\ts.items = append(s.items, x)\n\t}\n}\n\nfunc main() {\n\tfor i := 0; i < Max; i++ {\n\t\tfmt.Println(i)\n\t}\n}\n',
    'a.rs': 'use std::fmt;\n\npub const LIMIT: usize = 3;\n\n/// A stack.\n#[derive(Debug)]\npub struct Stack<\'a> {\n    items: Vec<&\'a str>,\n}\n\nimpl<\'a> Stack<\'a> {\n    pub fn push(&mut self, x: &\'a str) -> Result<(), String> {\n        match x { "{" => Err(format!("no")), _ => Ok(self.items.push(x)) }\n    }\n}\n\nfn main() {\n    let mut s = Stack { items: vec![] };\n    s.push("a").unwrap();\n}\n',
    'A.java': 'package x;\nimport java.util.List;\n\npublic class Stack extends Base {\n    private List<String> items;\n\n    @Override\n    public void push(String x, int n) throws Exception {\n        if (x == null) { throw new Exception("}"); }\n        items.add(x);\n    }\n\n    Stack() {\n        init();\n    }\n}\n',
    'a.c': '#include <stdio.h>\n#define LIMIT 3\n\nstruct point {\n    int x;\n};\n\nstatic int add(int a, int b)\n{\n    while (a < b) { a++; }\n    return a;\n}\n\nint main(void) {\n    printf("%d {", add(1, 2));\n    return 0;\n}\n',
    'a.kt': 'import a.b.C\nclass Box(val x: Int) : Base() {\n    fun open(y: Int): Int {\n        return when (y) { 1 -> C.make(y) else -> x }\n    }\n    fun short(z: Int) = z + 1\n}\n',
    'a.php': '<?php\nclass A extends B {\n  public function go($x, $y = 1) {\n    foreach ($x as $z) { call_me($z); }\n  }\n}\nfunction top() { return new A(); }\n',
    'p.html': '<html>\n<script>\nfunction hi(a) {\n  go(a);\n}\n</script>\n<p>text</p>\n',
}
#: unit type, name, first and last line, the type it belongs to, its base, parameters, calls.
EXPECTED = {
    'a.js': [
        ('function', 'add', 3, 6, None, None, ['a', 'b'], ['plus']),
        ('constant', 'LIMIT', 8, 8, None, None, [], []),
        ('function', 'twice', 9, 11, None, None, ['v'], ['add']),
        ('class', 'Stack', 12, 19, None, 'Base', [], []),
        ('method', 'constructor', 13, 15, 'Stack', None, ['items'], []),
        ('method', 'push', 16, 18, 'Stack', None, ['item'], ['push']),
    ],
    'a.go': [
        ('constant', 'Max', 5, 5, None, None, [], []),
        ('class', 'Stack', 7, 9, None, None, [], []),
        ('method', 'Push', 12, 16, 'Stack', None, ['x'], ['append']),
        ('function', 'main', 18, 22, None, None, [], ['Println']),
    ],
    'a.rs': [
        ('constant', 'LIMIT', 3, 3, None, None, [], []),
        ('class', 'Stack', 6, 9, None, None, [], []),
        ('method', 'push', 12, 14, 'Stack', None, ['x'], ['Err', 'Ok', 'format', 'push']),
        ('function', 'main', 17, 20, None, None, [], ['push', 'unwrap']),
    ],
    'A.java': [
        ('class', 'Stack', 4, 16, None, 'Base', [], []),
        ('method', 'push', 7, 11, 'Stack', None, ['x', 'n'], ['Exception', 'add']),
        ('method', 'Stack', 13, 15, 'Stack', None, [], ['init']),
    ],
    'a.c': [
        ('constant', 'LIMIT', 2, 2, None, None, [], []),
        ('class', 'point', 4, 6, None, None, [], []),
        ('function', 'add', 8, 12, None, None, ['a', 'b'], []),
        ('function', 'main', 14, 17, None, None, [], ['add', 'printf']),
    ],
    'a.kt': [
        ('class', 'Box', 2, 7, None, 'Base', [], []),
        ('method', 'open', 3, 5, 'Box', None, ['y'], ['make']),
        ('method', 'short', 6, 6, 'Box', None, ['z'], []),
    ],
    'a.php': [
        ('class', 'A', 2, 6, None, 'B', [], []),
        ('method', 'go', 3, 5, 'A', None, ['x', 'y'], ['call_me']),
        ('function', 'top', 7, 7, None, None, [], ['A']),
    ],
    'p.html': [
        ('function', 'hi', 3, 5, None, None, ['a'], ['go']),
    ],
}


@pytest.mark.parametrize("path", SNIPPETS)
def test_units_of(path):
    found = file_units(path, SNIPPETS[path])
    assert [(u["unit_type"], u["name"], u["line"], u["end_line"], u["parent_class"], u["extends"], u["parameters"], u["calls"]) for u in found if u["unit_type"] != "rawcode"] == EXPECTED[path]
    covered = {n for u in found for n in range(u["line"], u["end_line"] + 1)}
    assert {n for n, x in enumerate(SNIPPETS[path].split("\n"), 1) if x.strip()} <= covered


def test_flags_and_comments():
    push = next(u for u in file_units("a.js", SNIPPETS["a.js"]) if u["name"] == "push")
    assert push["has_loops"] and not push["has_branches"] and push["complexity"] == 2 and push["variables"] == ["x"]
    add = next(u for u in file_units("a.js", SNIPPETS["a.js"]) if u["name"] == "add")
    assert add["docstring"] == "Adds two." and add["imports"] == ["./lib/helper"] and add["has_branches"]
    java = {u["name"]: u for u in file_units("A.java", SNIPPETS["A.java"])}
    assert java["push"]["has_error_handling"] and java["push"]["qualified_name"] == "A.java::Stack::push"


def test_odd_sources():
    assert file_units("x.js", "{" * 2000) == [] and file_units("x.go", "") == []
    assert [u["unit_type"] for u in file_units("x.c", "int x;\n/* open")] == ["rawcode"]
    qml = {u["name"]: (u["unit_type"], u["line"], u["end_line"]) for u in file_units("x.qml", "import QtQuick\nItem {\n  function f(a) {\n    return a\n  }\n}\n") if u["unit_type"] != "rawcode"}
    assert qml == {"Item": ("class", 2, 6), "f": ("method", 3, 5)}
    assert skip_reason("x.zzz", "a") == "unknown language" and skip_reason("x.py", " ") == "no text" and skip_reason("x.py", "def (") == "no units" and skip_reason("x.go", "func f() {}") is None


def test_long_files_take_linear_time():
    import time

    source = "function f(a) { return g(a); }\n" * 8000
    began = time.perf_counter()
    assert len(file_units("x.js", source)) == 8000
    assert time.perf_counter() - began < 30
