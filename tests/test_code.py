from pyspark.sql import functions as F

from docindex.helpers import cpp, qt_ui
from docindex.operators import code


def files(spark, **contents):
    rows = [("p", name.replace("__", "."), "." + name.split("__")[-1], text) for name, text in contents.items()]
    return spark.createDataFrame(rows, "project string, relative_path string, ext string, content string")


def test_definitions():
    (f,) = cpp.definitions("int A::f(int x) {\n  return x;\n}\n")
    assert (f["name"], f["class_name"], f["kind"], f["signature"]) == ("f", "A", "method", "int A::f(int x)")
    assert (f["line_start"], f["line_end"]) == (1, 3) and f["body"].startswith("{") and f["body"].endswith("}")
    (g,) = cpp.definitions("\n\nint A::f(int x) {\n  return x;\n}\n")
    assert (g["line_start"], g["line_end"]) == (1, 5)
    assert [x["name"] for x in cpp.definitions("else if (x) {\n}")] == []
    assert [x["name"] for x in cpp.definitions("else if (x) {\n}", exclude_keywords=False)] == ["if"]
    both = cpp.definitions("void a() {}\nstruct S : B { int x; };\n")
    assert [(x["kind"], x["name"], x["order_no"]) for x in both] == [("struct", "S", 0), ("function", "a", 1)]
    assert cpp.definitions("void a() { '{' \"}\" \n")[0]["body"] == ""


def test_headers(spark):
    df = files(spark, a__h="class P {};\nint g(int a);\n", b__h="#define X 1\n", c__h="", d__h=None)
    (g,) = code.cpp_declarations(df).collect()
    assert (g["name"], g["signature"], g["line_start"]) == ("g", "int g(int a)", 2)
    (whole,) = code.header_fallback(df).collect()
    assert (whole["symbol"], whole["content"]) == ("b", "#define X 1\n")


def names(spark, line):
    return [r["api_name"] for r in code.api_calls(files(spark, a__cpp=line)).orderBy("call_no").collect()]


def test_calls(spark):
    assert names(spark, "obj->Foo(1); Bar(x); ns::Baz(2);") == ["Foo", "ns::Baz", "Bar", "Baz"]
    assert names(spark, "o->f(A::B)") == ["o->f"]
    assert names(spark, "Foo (x)") == ["Foo "]
    assert names(spark, "Outer(Inner(x))") == ["Outer"]
    assert names(spark, "// Foo(1)") == []


def test_first_calls_and_context(spark):
    text = "a\nFoo(1);\nb\nFoo(2); Bar(1);"
    rows = code.first_calls(files(spark, a__cpp=text), per_file=20).orderBy("call_no").collect()
    assert [(r["api_name"], r["line_number"]) for r in rows] == [("Foo", 2), ("Bar", 4)]
    assert rows[0]["context"] == text
    many = "\n".join(f"Fn{n}(1);" for n in range(30))
    assert code.first_calls(files(spark, a__cpp=many)).count() == 20


def test_exports(spark):
    text = "LIBRARY x\nEXPORTS\n  ; c\n  Init @1\n  Data1 @2 DATA\n  Hidden @3 NONAME PRIVATE\n  bad = name\nVERSION 1.0\n  After"
    rows = code.def_exports(files(spark, a__def=text, b__def="nothing", c__def=None)).orderBy("pos").collect()
    assert [(r["name"], r["ordinal"], r["is_data"]) for r in rows] == [("Init", 1, False), ("Data1", 2, True), ("Hidden", 3, False)]
    long = "EXPORTS\n" + "\n".join(f"e{n}" for n in range(51))
    (chunk,) = code.exports_chunks(files(spark, a__def=long)).collect()
    assert chunk["n_exports"] == 51 and chunk["content"].endswith("- e49\n...\n")


def test_scripts(spark):
    text = "# build it\n\nsome text\nmsbuild x.sln\nREM\ncd out"
    rows = code.script_commands(files(spark, a__tcmd=text)).orderBy("line_number").collect()
    assert [(r["line_number"], r["command"], r["description"]) for r in rows] == [(4, "msbuild x.sln", "build it"), (6, "cd out", "")]
    (chunk,) = code.script_chunks(files(spark, a__tcmd=text)).collect()
    assert chunk["content"] == "命令脚本: a.tcmd\n工程: p\n\n命令列表:\n\n# build it\nmsbuild x.sln\ncd out\n"
    assert code.script_chunks(files(spark, a__tcmd=text), 3).count() == 0


UI = '<ui version="4.0"><class>Dlg</class><widget class="QDialog" name="Dlg"><layout><item row="0" column="1"><widget class="QPushButton" name="ok"><property name="text"><string>OK</string></property></widget></item></layout></widget><connections><connection><sender>ok</sender><signal>clicked()</signal><receiver>Dlg</receiver><slot>accept()</slot></connection></connections></ui>'


def test_widgets(spark):
    got = qt_ui.parse(UI)
    assert [(w["object_name"], w["depth"], w["row"], w["column"], w["properties"]) for w in got["widgets"]] == [("Dlg", 0, None, None, {}), ("ok", 1, 0, 1, {"text": "OK"})]
    assert qt_ui.tree_text(got["widgets"]) == "- QDialog (objectName: Dlg)\n  - QPushButton (objectName: ok)\n    text: OK"
    assert qt_ui.parse("<ui>") is None and qt_ui.parse("<ui/>") is None
    nested = UI.replace("<item row", "<item><layout><item><widget class='QLabel' name='l'/></item></layout></item><item row")
    assert [w["object_name"] for w in qt_ui.parse(nested)["widgets"]] == ["Dlg", "ok", "l"]
    df = files(spark, a__ui=UI, b__ui="<broken", c__ui=None)
    assert code.ui_connections(df).count() == 1
    assert [r["symbol"] for r in code.ui_structure_chunks(df).collect()] == ["Dlg"]
    assert {r["symbol"] for r in code.ui_widget_chunks(df).collect()} == {"Dlg", "ok"}


def test_all_kinds(spark):
    df = files(spark, a__h="int g(int a);", b__cpp="void f() { Go(1); }", c__ui=UI, d__def="EXPORTS\nx", e__tcmd="cd x", f__txt="no", g__h="  ")
    rows = code.chunk_code(df).collect()
    assert {(r["relative_path"], r["chunk_type"], r["symbol"]) for r in rows} == {("a.h", "function", "g"), ("b.cpp", "function", "f"), ("b.cpp", "call_snippet", "Go"), ("c.ui", "ui_structure", "Dlg"), ("c.ui", "ui_structure", "ok"), ("d.def", "exports", "exports"), ("e.tcmd", "command", "e")}
    assert len({(r["relative_path"], r["chunk_no"]) for r in rows}) == len(rows)
    same = code.chunk_code(df.repartition(7)).select(F.sort_array(F.collect_list("content")))
    assert same.count() == 1


def test_large_files(spark):
    source = "".join(f"// no. {n}\n\n\nstatic int C{n}::run(int a) {{\n  return a + {n};\n}}\n" for n in range(50_000)) + "\n" * 500_000
    header = "".join(f"int declared{n}(int a, int b);\n" for n in range(80_000))
    widgets = "".join(f'<widget class="QPushButton" name="button{n}"/>' for n in range(50_000))
    ui = f'<ui version="4.0"><class>D</class><widget class="QDialog" name="D">{widgets}</widget></ui>'
    assert min(map(len, (source, header, ui))) > 2_000_000
    df = files(spark, a__cpp=source, b__h=header, c__ui=ui)
    assert code.cpp_functions(df).count() == 50_000
    assert code.cpp_declarations(df).count() == 80_000 and code.header_fallback(df).count() == 0
    assert code.ui_widgets(df).count() == 50_001


_TOKENS = ["int ", "f", "A::f", "*x", "&", "(", ")", "(int a)", "{", "}", ";", "\n", "\n\n", "  ", "\t", "class ", "struct S", " : B", "template <class T>", "template<", ">", "<", ",", "const", " override", " noexcept", "static ", "virtual\n", "__declspec(x)", "__declspec", "'", '"', "\\", "//don't", "if (x) {", "void g() {\n}\n", "int h(int a);\n", "= 0"]


def test_the_scan_finds_what_the_expressions_find():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def plain_brace(text, start):
        depth, quote = 0, ""
        for at in range(start, len(text)):
            c = text[at]
            if c in "\"'" and text[at - 1 : at] != "\\":
                quote = c if not quote else "" if quote == c else quote
            elif c in "{}" and not quote:
                depth += 1 if c == "{" else -1
                if not depth:
                    return at
        return -1

    @settings(max_examples=2000, deadline=None)
    @given(st.lists(st.sampled_from(_TOKENS), max_size=40).map("".join))
    def run(text):
        for mine, pattern in ((cpp._functions, cpp.FUNCTION), (cpp._declarations, cpp.DECLARATION), (cpp._classes, cpp.CLASS)):
            assert [m.span() for m in mine(text)] == [m.span() for m in pattern.finditer(text)]
        braces = cpp.Braces(text)
        assert all(braces.closing(i) == plain_brace(text, i) for i, c in enumerate(text) if c == "{")

    run()


def test_linear_time():
    import time

    shapes = {
        "words": "some words here\n" * 100_000,
        "words, then a call": "some words here\n" * 100_000 + "x (y);\n",
        "templates": "template <class T>\n" * 50_000,
        "open templates": "template <class T, \n" * 50_000 + ">",
        "open calls": "int f (\n" * 50_000 + ")",
        "modifiers": "static\n" * 50_000 + "__declspec(x) ;",
        "bases": "class A : b\n" * 50_000,
        "nested classes": "class A {\n" * 2000 + "}" * 2000,
        "nested blocks": "void f() {\n" * 20_000 + "}\n" * 20_000,
    }
    for name, text in shapes.items():
        began = time.process_time()
        cpp.definitions(text)
        cpp.declarations(text)
        assert time.process_time() - began < 5, name


def test_nested_layouts():
    import random
    import time
    from xml.etree import ElementTree as ET

    def listed_once(xml):
        """Everything that is listed, in order, the first time that it is."""
        top, out, seen = ET.fromstring(xml).find("widget"), [], set()

        def go(widget, parent, depth):
            if id(widget) in seen:
                return
            seen.add(id(widget))
            number = len(out)
            out.append((widget.get("name"), parent, depth))
            for w, *_ in [*qt_ui._children(widget)]:
                go(w, number, depth + 1)

        go(top, None, 0)
        return out

    rng = random.Random(1)

    def grow(depth):
        kind = rng.choice(["widget", "layout", "item", "other"]) if depth else "widget"
        inside = "".join(grow(depth + 1) for _ in range(rng.randrange(4))) if depth < 6 else ""
        return f'<{kind} name="n{rng.randrange(10**9)}">{inside}</{kind}>'

    for _ in range(300):
        xml = f"<ui>{grow(0)}</ui>"
        assert [(w["object_name"], w["parent_no"], w["depth"]) for w in qt_ui.parse(xml)["widgets"]] == listed_once(xml)
    deep = "<ui><widget>" + "<layout><item>" * 5000 + '<widget name="in"/>' + "</item></layout>" * 5000 + "</widget></ui>"
    wide = "<ui>" + '<widget name="w"><layout><item>' * 2000 + "</item></layout></widget>" * 2000 + "</ui>"
    began = time.process_time()
    assert len(qt_ui.parse(deep)["widgets"]) == 2 and len(qt_ui.parse(wide)["widgets"]) == 2000
    assert time.process_time() - began < 2
