"""Registered queries over C files put together from units of many shapes, in an order that each file's row decides.

A unit is a piece of C with what must be read in it, lines counted from its first; {k} is the part's key, {j} the unit's
place in its file, {z} the part's size.  SQL adds up the lines of the units before.  A unit may leave a brace open: what
follows has to be read all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runpath.plans.c_queries import filled, values
from runpath.plans.registry import query, table
from runpath.plans.session import AnalysisSession
from runpath.sources import c_front

UNITS = [
    "static int plain_{k}_{j}(struct dev *d, int n)\n{\n\treturn helper_{j}(d, n); /* not } here */\n}\n",
    "#ifdef CONFIG_A\nint cond_{k}_{j}(int a) {\n#else\nint cond_{k}_{j}(void) {\n#endif\n\tif (ready(a)) {\n\t\tgo(\"}\");\n\t}\n\treturn 0;\n}\n",
    "int lost_{k}_{j}(int x)\n{\n\tif (x) {\n\t\tstop(x);\n\treturn 1;\n}\n",
    "static __attribute__((unused)) int attr_{k}_{j}(void)\n{\n\treturn 0;\n}\n",
    "SYSCALL_DEFINE2(call_{k}_{j}, unsigned int, fd, char __user *, buf)\n{\n\treturn do_call(fd);\n}\n",
    "int old_{k}_{j}(a, b)\n\tint a;\n\tchar *b;\n{\n\treturn a;\n}\n",
    "int (*get_{k}_{j}(int a))(int b)\n{\n\treturn pick(a);\n}\n",
    "struct big_{k}_{j} {\n\tint a, *b;\n\tunsigned low:3, :4, high:2;\n\tunion {\n\t\tlong u;\n\t\tstruct part *p;\n\t};\n\tint (*ops[4])(int n);\n\tvoid (*done)(struct big_{k}_{j} *m);\n\tstruct {\n\t\tint w;\n\t} in;\n};\n",
    "void flow_{k}_{j}(void)\n{\n\tif (a{j})\n\t\tp{j} = &x{j};\n\tfor (;;)\n\t\tq{j} = p{j};\n\twhile (more)\n\t\tn{j}++;\n\tr{j} = *q{j};\n\t*q{j} = s{j};\n\tt{j} = o{j}->m;\n\to{j}->m = s{j};\n\th{j}[2] = s{j};\n\tu{j} = h{j}[i];\n\tv{j} = c ? p{j} : &y{j};\n}\n",
    "int facts_{k}_{j}(struct dev *d)\n{\n\td->cb = facts_{k}_{j};\n\ttab[3] = facts_{k}_{j};\n\tregister_hook(\"x\", facts_{k}_{j});\n\tsignal_connect(sig{j}, facts_{k}_{j});\n\tqueue_work(wq, &d->work);\n\twhile (1) {\n\t\ttab[next()](d);\n\t}\n\td->cb(1);\n\t(*fp{j})(2);\n\twhile (x) y++;\n\treturn 0;\n}\n",
    "int takes_{k}_{j}(int (*cb)(struct dev *d, int n), void *data)\n{\n\treturn cb(data, {z});\n}\ntypedef void (*done_{k}_{j}_t)(int n);\n",
    "extern \"C\" {\nint link_{k}_{j}(void)\n{\n\treturn 0;\n}\n}\n",
    "DEFINE_HANDLER(macro_{k}_{j})\n{\n\trun();\n}\nEXPORT_SYMBOL(macro_{k}_{j})\n",
    "#ifdef CONFIG_B\nint left_{k}_{j}(void)\n{\n\treturn 0;\n}\n#else\nint right_{k}_{j}(void)\n{\n\treturn 1;\n}\n#endif\n",
]
N = len(UNITS)
#: What each unit holds: (unit, name, first line, last line, return type, parameters, attributes, callees).
FUNCTIONS = [
    (0, "plain_{k}_{j}", 1, 4, "int", "d:struct dev *,n:int", "static", "helper_{j}"),
    (1, "cond_{k}_{j}", 2, 10, "int", "a:int", "", "go,ready"),
    (2, "lost_{k}_{j}", 1, 6, "int", "x:int", "", "stop"),
    (3, "attr_{k}_{j}", 1, 4, "int", "", "static", ""),
    (4, "sys_call_{k}_{j}", 1, 4, "long", "fd:unsigned int,buf:char __user *", "SYSCALL_DEFINE2", "do_call"),
    (5, "old_{k}_{j}", 1, 6, "int", "a:int,b:char *", "", ""),
    (6, "get_{k}_{j}", 1, 4, "int (*)(int b)", "a:int", "", "pick"),
    (8, "flow_{k}_{j}", 1, 16, "void", "", "", ""),
    (9, "facts_{k}_{j}", 1, 15, "int", "d:struct dev *", "", "next,queue_work,register_hook,signal_connect"),
    (10, "takes_{k}_{j}", 1, 4, "int", "cb:int (*)(struct dev *d, int n),data:void *", "", "cb"),
    (11, "link_{k}_{j}", 2, 5, "int", "", "", ""),
    (12, "macro_{k}_{j}", 1, 4, "", "", "DEFINE_HANDLER", "run"),
    (13, "left_{k}_{j}", 2, 5, "int", "", "", ""),
    (13, "right_{k}_{j}", 7, 10, "int", "", "", ""),
]
FIELDS = "a|int|false|,b|int *|true|,low|unsigned|false|,high|unsigned|false|,u|long|false|,p|struct part *|true|,ops|int|true|int (*[4])(int n),done|void|true|void (*)(struct big_{k}_{j} *m),in|struct|false|"
CONSTRAINTS = [
    (8, "AddressOf", "p{j}", "x{j}", None), (8, "Copy", "q{j}", "p{j}", None), (8, "Load", "r{j}", "q{j}", None), (8, "Store", "q{j}", "s{j}", None), (8, "FieldLoad", "t{j}", "o{j}", "m"),
    (8, "FieldStore", "o{j}", "s{j}", "m"), (8, "ArrayStore", "h{j}", "s{j}", None), (8, "ArrayLoad", "u{j}", "h{j}", None), (8, "Copy", "v{j}", "p{j}", None), (8, "AddressOf", "v{j}", "y{j}", None),
    (9, "FieldStore", "d", "facts_{k}_{j}", "cb"), (9, "ArrayStore", "tab", "facts_{k}_{j}", None),
]
FACTS = [
    (9, "binding", 3, "d->cb", "facts_{k}_{j}"), (9, "binding", 4, "tab[*]", "facts_{k}_{j}"), (9, "registration", 5, "register_hook", "facts_{k}_{j}"), (9, "registration", 6, "signal_connect", "facts_{k}_{j}"),
    (9, "signal", 6, "sig{j}", "facts_{k}_{j}"), (9, "queue", 7, "queue_work", "d->work"), (9, "event_loop", 8, "tab[next()]", None), (9, "invocation", 9, "tab[next()]", None), (9, "invocation", 11, "d->cb", None),
    (9, "invocation", 12, "fp{j}", None),
]
POINTERS = [
    (7, "StructField", "big_{k}_{j}.ops", "int", "int", 1), (7, "StructField", "big_{k}_{j}.done", "void", "struct big_{k}_{j} *", 1),
    (10, "Param", "takes_{k}_{j}.cb", "int", "struct dev *,int", 1), (10, "Typedef", "done_{k}_{j}_t", "void", "int", 5),
]


def unit_of(z: Column, k: Column, j: Column) -> Column:
    return (k * 7 + j * (z % 13 + 1)) % N


def unit_files(s: SparkSession, d: str) -> DataFrame:
    """files(path, content) of 3 to 7 units."""
    x = c_front.dealt(table(s, d, "part")).select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("z"))
    all_units = F.array(*(F.lit(u) for u in UNITS))
    piece = lambda j: F.replace(F.element_at(all_units, (unit_of(F.col("z"), F.col("k"), j) + 1).cast("int")), F.lit("{j}"), j.cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("z") % 5 + 2), piece), "")
    return x.select(F.concat(F.lit("u"), F.col("k").cast("string"), F.lit(".c")).alias("path"), filled("{text}", {"text": text, "k": F.col("k"), "z": F.col("z")}).alias("content"))


def _fill(column: str) -> str:
    return f"replace(replace(replace({column}, '{{k}}', CAST(k AS VARCHAR)), '{{j}}', CAST(j AS VARCHAR)), '{{z}}', CAST(z AS VARCHAR))"


#: SQL: (path, k, z, j, unit, before: lines of the units before, is_last).
_U = f"""u AS (SELECT 'u' || k || '.c' AS path, k, z, j, unit, CAST(coalesce(sum(lines) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS before, j = z % 5 + 2 AS is_last
 FROM (SELECT p_partkey AS k, p_size AS z, unnest(range(0, p_size % 5 + 3)) AS j FROM part) JOIN {values(*((i, u.count(chr(10))) for i, u in enumerate(UNITS)))} v(unit, lines) ON unit = (k * 7 + j * (z % 13 + 1)) % {N})"""


@query("c_unit_functions", f"""WITH {_U} SELECT path, {_fill('name')} AS name, before + line AS line, before + end_line AS end_line, ret, {_fill('params')} AS params, attrs, {_fill('calls')} AS calls
 FROM u JOIN {values(*FUNCTIONS)} f(unit, name, line, end_line, ret, params, attrs, calls) USING (unit) WHERE NOT (unit = 2 AND is_last)""")
def _(s, d):
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["type_name"])), ",")
    return AnalysisSession(s, unit_files(s, d)).defined.select("path", "name", "line", "end_line", F.col("return_type").alias("ret"), params.alias("params"), F.array_join("attributes", ",").alias("attrs"), F.array_join("calls", ",").alias("calls"))


@query("c_unit_structs", f"WITH {_U} SELECT path, {_fill(repr('big_{k}_{j}'))} AS name, before + 1 AS line, before + 13 AS end_line, 'part' AS refs, {_fill(repr(FIELDS))} AS fields FROM u WHERE unit = 7")
def _(s, d):
    show = F.transform("fields", lambda f: F.concat_ws("|", f["name"], f["type_name"], f["is_pointer"].cast("string"), F.coalesce(f["signature"], F.lit(""))))
    return AnalysisSession(s, unit_files(s, d)).structs.select("path", "name", "line", "end_line", F.array_join("referenced_structs", ",").alias("refs"), F.array_join(show, ",").alias("fields"))


@query("c_unit_errors", f"WITH {_U} SELECT path, 'unbalanced brace at line ' || (before + 2) AS error FROM u WHERE unit = 2")
def _(s, d):
    return AnalysisSession(s, unit_files(s, d)).errors


@query("c_unit_constraints", f"WITH {_U} SELECT path, kind, {_fill('dest')} AS dest, {_fill('src')} AS src, field FROM u JOIN {values(*CONSTRAINTS)} c(unit, kind, dest, src, field) USING (unit)")
def _(s, d):
    return AnalysisSession(s, unit_files(s, d)).constraints()


@query("c_unit_facts", f"WITH {_U} SELECT path, fact, before + line AS line, {_fill('target')} AS target, {_fill('name')} AS name FROM u JOIN {values(*FACTS)} f(unit, fact, line, target, name) USING (unit)")
def _(s, d):
    x = unit_files(s, d)
    return c_front.callback_facts(x, AnalysisSession(s, x).defined.select("path", "name"))


@query("c_unit_types", f"""WITH {_U} SELECT path, kind, {_fill('name')} AS name, ret AS return_type, {_fill('params')} AS params, before + line AS line FROM u JOIN {values(*POINTERS)} t(unit, kind, name, ret, params, line) USING (unit)""")
def _(s, d):
    return c_front.pointer_types(unit_files(s, d)).where("kind <> 'Function'").withColumn("params", F.array_join("params", ","))


@query("c_unit_callbacks", f"""WITH {_U}, f AS (SELECT path, expr, unnest([facts]) AS h FROM (SELECT path, {_fill(repr('facts_{k}_{j}'))} AS facts, unnest(['d->cb', 'tab[next()]']) AS expr FROM u WHERE unit = 9))
 SELECT path, expr, array_to_string(list_sort(list(DISTINCT h)), ',') AS handlers FROM f GROUP BY path, expr""")
def _(s, d):
    """All files bind the same names: a call meets the bindings of its own file only."""
    return AnalysisSession(s, unit_files(s, d)).resolved_callbacks().select("path", "expr", F.array_join("handlers", ",").alias("handlers"))
