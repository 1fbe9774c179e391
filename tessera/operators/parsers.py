"""Language parsers: one file becomes chunks, in Arrow batches.

Python files go through the syntax tree, HTML through a parser that knows true
positions, Java through a scanner that skips strings and comments; everything
else, and whatever can't be parsed, through the line chunker's rules. A parser
is a function from (path, text) to rows; :func:`parse` picks it by suffix.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layers
from ..schemas import PARSED

LEAST, MOST, OVERLAP = 50, 500, 20
COLUMNS = [c.split(" ")[0] for c in PARSED.split(", ")]
#: Class lines from which methods get chunks of their own.
LONG_CLASS = 20


def row(path: str, language: str, start: int, end: int, content: str, function: str | None = None, owner: str | None = None, layer: str = "Unknown", **metadata) -> tuple:
    """A chunk; metadata values become text."""
    kept = {k: v if isinstance(v, str) else ",".join(map(str, v)) if isinstance(v, (list, tuple, set)) else str(v) for k, v in metadata.items() if v is not None}
    return (path, language, start, end, function, owner, layer, len(content) // 4, content, kept)


def lines_of(path: str, text: str, language: str = "unknown", least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> list[tuple]:
    """Greedy line chunks, as :func:`tessera.operators.chunks.line_chunks` makes them."""
    out, held, size, start = [], [], 0, 1
    for n, line in enumerate(text.split("\n"), 1):
        if size + len(line) // 4 > most and size >= least:
            out.append((start, held))
            tail, room = [], overlap * 4
            for x in reversed(held):
                if len(x) > room:
                    break
                room -= len(x)
                tail.insert(0, x)
            held, size, start = tail, sum(len(x) // 4 for x in tail), n - len(tail)
        held = [*held, line]
        size += len(line) // 4
    if size >= least:
        out.append((start, held))
    return [row(path, language, s, s + len(h) - 1, "\n".join(h)) for s, h in out if "\n".join(h).strip()]


# ---- Python -----------------------------------------------------------------


def dotted(node: ast.AST) -> str:
    """Dotted name of a decorator, base class or annotation."""
    after: list[str] = []  # what follows the innermost name, outermost first
    while isinstance(node, (ast.Call, ast.Attribute, ast.Subscript)):
        if isinstance(node, ast.Attribute):
            after.append(f".{node.attr}")
        elif isinstance(node, ast.Subscript):
            after.append(f"[{dotted(node.slice)}]")
        node = node.func if isinstance(node, ast.Call) else node.value
    name = str(node.value) if isinstance(node, ast.Constant) else node.id if isinstance(node, ast.Name) else "Any"
    return name + "".join(reversed(after))


def imports_of(tree: ast.Module) -> tuple[set[str], dict[str, set[str]]]:
    """Top packages, and names by module they come from."""
    modules, names = set(), {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            modules |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            modules.add(node.module.split(".")[0])
            names.setdefault(node.module, set()).update(a.name for a in node.names)
    return modules, names


def arguments_of(args: ast.arguments) -> list[str]:
    """name:annotation of each argument; *args and **kwargs are typed so."""
    plain = [f"{a.arg}:{dotted(a.annotation) if a.annotation else 'Any'}" for a in [*args.posonlyargs, *args.args, *args.kwonlyargs]]
    more = [(args.vararg, "*{}:vararg"), (args.kwarg, "**{}:kwarg")]
    return plain + [form.format(a.arg) for a, form in more if a]


def path_layer(path: str) -> str:
    """Layer of a Python file, as :func:`tessera.functions.layers.python_path_layer`."""
    low = path.replace("\\", "/").lower()
    name = low.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    for layer, parts, stems, starts, ends in layers.PYTHON_PATHS:
        if any(x in low for x in parts) or stem in stems or stem.startswith(tuple(starts)) or stem.endswith(tuple(ends)):
            return layer
    return "Unknown"


def framework_of(modules: set[str]) -> str | None:
    """As :func:`tessera.functions.layers.framework_from_imports`."""
    known = (("django", {"django", "rest_framework"}), ("flask", {"flask"}), ("fastapi", {"fastapi"}))
    return next((name for name, marks in known if marks & modules), None)


def class_layer(name: str, bases: list[str], decorators: list[str], framework: str | None, file_layer: str) -> str:
    """As :func:`tessera.functions.layers.python_class_layer`; a dotted base counts by its last part too."""
    low, given = name.lower(), {x for b in bases for x in (b.lower(), b.lower().rsplit(".", 1)[-1])}
    for layer, names in layers.CLASS_BASES.get(framework, ()):
        if given & set(names):
            return layer
    if framework == "django" and "middleware" in low:
        return "Middleware"
    if any("test" in d.lower() for d in decorators):
        return "Test"
    return next((layer for layer, parts in layers.CLASS_NAMES if any(x in low for x in parts)), file_layer)


def function_layer(decorators: list[str], framework: str | None, parent: str) -> str:
    """As :func:`tessera.functions.layers.python_function_layer`."""
    given = {x for d in decorators for x in (d.lower(), d.lower().rsplit(".", 1)[-1])}
    return next((layer for layer, names in layers.FUNCTION_DECORATORS.get(framework, ()) if given & set(names)), parent)


def python_function(path: str, node: ast.FunctionDef | ast.AsyncFunctionDef, lines: list[str], owner: str | None, least: int, framework: str | None = None, parent: str = "Unknown") -> tuple | None:
    """A function's chunk, if it is more than a line or two."""
    start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    content = "\n".join(lines[start - 1 : node.end_lineno])
    if node.end_lineno - start < 2 or len(content) // 4 < least:
        return None
    name, decorators = node.name, [dotted(d) for d in node.decorator_list]
    dunder = name.startswith("__") and name.endswith("__")
    return row(path, "python", start, node.end_lineno, content, name, owner, function_layer(decorators, framework, parent), type="method" if owner else "function", framework=framework, decorators=decorators, arguments=arguments_of(node.args), returns=dotted(node.returns) if node.returns else None, docstring=(ast.get_docstring(node) or "")[:200], is_async=isinstance(node, ast.AsyncFunctionDef), is_private=name.startswith("_") and not dunder, is_dunder=dunder)


def python_chunks(path: str, text: str, least: int = 10) -> list[tuple]:
    """Top-level classes and functions; methods of long classes; lines if there are none or the syntax is broken."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return python_by_indent(path, text) or lines_of(path, text, "python")
    lines, out = text.split("\n"), []
    modules, names = imports_of(tree)
    framework, of_file = framework_of(modules), path_layer(path)
    froms = [f"{m}:{'|'.join(sorted(x))}" for m, x in sorted(names.items())]
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            bases, decorators = [dotted(b) for b in node.bases], [dotted(d) for d in node.decorator_list]
            layer = class_layer(node.name, bases, decorators, framework, of_file)
            out.append(row(path, "python", start, node.end_lineno, "\n".join(lines[start - 1 : node.end_lineno]), None, node.name, layer, type="class", framework=framework, bases=bases, decorators=decorators, imports=sorted(modules), from_imports=froms, docstring=(ast.get_docstring(node) or "")[:200]))
            if node.end_lineno - start > LONG_CLASS:
                out += [c for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and (c := python_function(path, m, lines, node.name, least, framework, layer))]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and (c := python_function(path, node, lines, None, least, framework, of_file)):
            out.append(c)
    return out or lines_of(path, text, "python")


def python_symbols(path: str, text: str) -> list[tuple]:
    """file_path, kind (import, function, class, variable), name, owner, line, detail of a module's top level: functions without methods, classes with their annotated variables and methods' signatures."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out, functions = [], (ast.FunctionDef, ast.AsyncFunctionDef)
    signature = lambda f: ", ".join(arguments_of(f.args)) + (f" -> {dotted(f.returns)}" if f.returns else "")
    for node in tree.body:
        if isinstance(node, ast.Import):
            out += [(path, "import", a.name, None, node.lineno, a.asname) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(path, "import", a.name, "." * node.level + (node.module or ""), node.lineno, a.asname) for a in node.names]
        elif isinstance(node, functions):
            out.append((path, "function", node.name, None, node.lineno, signature(node)))
        elif isinstance(node, ast.ClassDef):
            out.append((path, "class", node.name, None, node.lineno, ", ".join(map(dotted, node.bases))))
            out += [(path, "variable", m.target.id, node.name, m.lineno, dotted(m.annotation)) for m in node.body if isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name)]
            out += [(path, "method", m.name, node.name, m.lineno, signature(m)) for m in node.body if isinstance(m, functions)]
    return out


def symbols(files: DataFrame) -> DataFrame:
    """:func:`python_symbols` of ``files`` (path, text)."""
    names = ["file_path", "kind", "name", "owner", "line", "detail"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame((s for p, t in zip(batch["path"], batch["text"]) for s in python_symbols(p, t or "")), columns=names)

    return files.select("path", "text").mapInPandas(run, "file_path string, kind string, name string, owner string, line int, detail string")


def python_by_indent(path: str, text: str) -> list[tuple]:
    """Blocks of broken Python by indentation: classes, their methods, and functions outside of these."""
    lines, out, owners = text.split("\n"), [], []
    indents = [len(x) - len(x.lstrip()) if x.strip() and not x.lstrip().startswith("#") else None for x in lines]
    ends, n = indent_ends(indents), 0
    while n < len(lines):
        m = re.match(r"(\s*)(class|(?:async\s+)?def)\s+(\w+)", lines[n])
        if not m:
            n += 1
            continue
        while owners and owners[-1][0] <= n:
            owners.pop()
        end, is_class = ends[n], m[2] == "class"
        owner = owners[-1][1] if owners and not is_class else None
        kind = "class" if is_class else "method" if owner else "function"
        out.append(row(path, "python", n + 1, end, "\n".join(lines[n:end]), None if is_class else m[3], m[3] if is_class else owner, path_layer(path), type=kind, parsed_by="indentation"))
        if is_class:
            owners.append((end, m[3]))
            n += 1  # its methods are blocks too
        else:
            n = end
    return out


def python_metrics(text: str) -> dict[str, float]:
    """Cyclomatic and cognitive complexity, nesting, type-hint coverage; zeros for broken syntax."""
    zero = dict.fromkeys(("cyclomatic", "cognitive", "nesting", "functions", "hinted_returns", "hinted_parameters"), 0.0)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return zero
    cyclomatic = 1
    for n in ast.walk(tree):
        if isinstance(n, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.Assert, ast.comprehension)):
            cyclomatic += 1
        elif isinstance(n, ast.BoolOp):
            cyclomatic += len(n.values) - 1

    # a stack of its own: long elif chains and sums are deep trees
    cognitive, nesting, stack = 0, 0, [(tree, 0, 0)]
    while stack:
        node, loops, blocks = stack.pop()
        nesting = max(nesting, blocks)
        for child in ast.iter_child_nodes(node):
            nests = isinstance(child, (ast.If, ast.While, ast.For, ast.AsyncFor))
            cognitive += 1 + loops if nests or isinstance(child, ast.ExceptHandler) else int(isinstance(child, ast.BoolOp))
            stack.append((child, loops + nests, blocks + isinstance(child, (ast.If, ast.While, ast.For, ast.With, ast.Try))))

    functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    parameters = [a for f in functions for a in f.args.args]
    return {"cyclomatic": float(cyclomatic), "cognitive": float(cognitive), "nesting": float(nesting), "functions": float(len(functions)), "hinted_returns": sum(f.returns is not None for f in functions) / max(1, len(functions)), "hinted_parameters": sum(a.annotation is not None for a in parameters) / max(1, len(parameters))}


def python_pieces(path: str, text: str, least: int = LEAST, most: int = MOST) -> list[tuple]:
    """Semantic chunks within two sizes: imports, classes (whole, or header and methods), functions (split at statements); small neighbours merged."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return line_parts(path, text, least, most)
    lines, out = text.split("\n"), []
    size = lambda a, b: len("\n".join(lines[a - 1 : b])) // 4
    add = lambda a, b, kind, f=None, c=None: out.append(row(path, "python", a, b, "\n".join(lines[a - 1 : b]), f, c, type=kind))
    found = [n for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    if found and size(found[0].lineno, found[-1].end_lineno) >= 10:
        add(found[0].lineno, found[-1].end_lineno, "imports")

    def by_lines(start: int, stop: int, kind: str, name: str | None, owner: str | None) -> tuple[int, int]:
        """Cut parts off while what is left is too large; the next line and part number."""
        part = 1
        while size(start, stop) > most:
            cut, held = start, len(lines[start - 1])
            while cut < stop and (held + 1 + len(lines[cut])) // 4 <= most:
                held += 1 + len(lines[cut])
                cut += 1
            add(start, cut, kind, name and f"{name}_part{part}", owner)
            start, part = cut + 1, part + 1
        return start, part

    def function(node, owner: str | None) -> None:
        a, b = min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno
        if size(a, b) <= most:
            if size(a, b) >= least:
                add(a, b, "method" if owner else "function", node.name, owner)
            return
        # before statements that control others once a part is large enough, and anywhere once it would be too large
        start, part = a, 1
        control = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)
        for stop in [s.lineno - 1 for s in node.body if isinstance(s, control)] + [b]:
            while size(start, stop) > most:
                cut, held = start, len(lines[start - 1])
                while (held + 1 + len(lines[cut])) // 4 <= most:
                    held += 1 + len(lines[cut])
                    cut += 1
                add(start, cut, "function_part", f"{node.name}_part{part}", owner)
                start, part = cut + 1, part + 1
            if stop >= start and (size(start, stop) >= least or stop == b):
                add(start, stop, "function_part", f"{node.name}_part{part}", owner)
                start, part = stop + 1, part + 1

    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            if size(node.lineno, node.end_lineno) <= most:
                add(node.lineno, node.end_lineno, "class", None, node.name)
                continue
            methods = [m for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            header = (methods[0].lineno - 1) if methods else node.end_lineno
            start, part = by_lines(node.lineno, header, "class_header", None, node.name)
            if start <= header and (size(start, header) >= least or part > 1):
                add(start, header, "class_header", None, node.name)
            for m in methods:
                function(m, node.name)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, None)
    return merged_pieces(path, out, least, most) or line_parts(path, text, least, most)


def merged_pieces(path: str, pieces: list[tuple], least: int, most: int) -> list[tuple]:
    """Neighbours of one type joined by an empty line while they fit into ``most``; a run under ``least`` that another type ends stays apart."""
    out: list[tuple] = []
    run: list[tuple] = []

    def end(whole: bool) -> None:
        if len(run) > 1 and whole:
            first = run[0]
            out.append(row(path, "python", first[2], run[-1][3], "\n\n".join(c[8] for c in run), first[4], first[5], type="merged", merged=len(run), of=first[9]["type"]))
        else:
            out.extend(run)
        run.clear()

    for c in pieces:
        if run and run[0][9]["type"] != c[9]["type"]:
            end(sum(x[7] for x in run) >= least)
        elif run and (sum(len(x[8]) + 2 for x in run) + len(c[8])) // 4 > most:
            end(True)
        run.append(c)
    end(True)
    return out


def line_parts(path: str, text: str, least: int = LEAST, most: int = MOST) -> list[tuple]:
    """Parts that end with the line that fills them, without overlap; a last part under ``least`` is left out."""
    out, held, size, start = [], [], 0, 1
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        held.append(line)
        size += len(line) // 4
        if size >= most or n == len(lines):
            if size >= least:
                out.append(row(path, "python", start, n, "\n".join(held), type="fallback"))
            held, size, start = [], 0, n + 1
    return out


# ---- Java -------------------------------------------------------------------

#: A type's keyword and name; its modifiers are read backwards from there, and its header ends at the next brace.
TYPE = re.compile(r"\b(class|interface|enum|record)\s++(\w++)")
#: A method's name, arguments and opening brace; its header is read backwards from there, so the scan is linear.
METHOD = re.compile(r"(?<![\w.])(\w++)\s*+\(([^()]*+)\)\s*+(?:throws\s++[\w.]++(?:\s*+,\s*+[\w.]++)*+\s*+)?+\{")
RETURNS = re.compile(r"[\w.<>\[\], ?&]+")
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "default", "native"}
TYPE_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "sealed"}
#: Words that look like a return type or a method's name before a block.
NOT_TYPES, NOT_NAMES = {"return", "new", "else", "throw", "case", "do", "try"}, {"if", "for", "while", "switch", "catch", "synchronized", "try"}


def blanked(text: str) -> str:
    """Java with strings and comments replaced by blanks of the same length; an open string ends with its line, an open comment with the text."""
    return re.sub(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*+"?|\'(?:\\.|[^\'\\\n])*+\'?', lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def brace_ends(code: str) -> dict[int, int]:
    """The offset after the brace that closes each opening one; one pass."""
    ends, open_ = {}, []
    for m in re.finditer("[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.end()
    return ends


def header_of(code: str, name: int, floor: int, marks: list[int]) -> tuple[int, list[str]] | None:
    """Where the header before a method's name begins, and its words without annotations; None if it is no method's. ``marks`` are the places of ;{})."""
    k = bisect_left(marks, name)
    begin = max(floor, marks[k - 1] + 1 if k else 0)
    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", code[begin:name]) if not m[0].startswith("@")]
    return (begin + words[0][0], [w for _, w in words]) if words else None


def parameter_names(text: str) -> list[str]:
    """Names in a parameter list; commas between angle brackets don't part."""
    plain, depth = [], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        plain.append(" " if depth or c == ">" else c)
    return [x.split()[-1] for x in "".join(plain).split(",") if x.strip()]


def annotations_before(code: str, floor: int, end: int) -> int:
    """Where the annotations begin that stand right before ``end``."""
    begin, last = end, floor
    for m in re.finditer(r"@\w[\w.]*+\s*+(?:\([^()]*+\)\s*+)?+", code[floor:end]):
        if floor + m.start() != last or begin == end:
            begin = floor + m.start()
        last = floor + m.end()
    return begin if last == end else end


def spring_layer(name: str, content: str) -> str:
    """Layer by name and annotations."""
    from ..functions.layers import SPRING

    n, c = name.lower(), content.lower()
    return next((layer for layer, names, marks in SPRING if any(x in n for x in names) or any(x in c for x in marks)), "Unknown")


def java_chunks(path: str, text: str) -> list[tuple]:
    """Classes, interfaces and all methods in them; broken sources by indentation; lines if there are none."""
    code, out = blanked(text), []
    if code.count("{") != code.count("}"):
        return java_by_indent(path, text, code) or lines_of(path, text, "java")
    package = re.search(r"^[ \t]*package\s+([\w.]+)\s*;", code, re.M)
    ends, breaks = brace_ends(code), [m.start() for m in re.finditer("\n", text)]
    marks, heads = [m.start() for m in re.finditer("[;{})]", code)], [m.start() for m in re.finditer("[;{}]", code)]
    line = lambda at: bisect_left(breaks, at) + 1
    close = lambda brace: ends.get(brace, len(code))
    methods, types = list(METHOD.finditer(code)), list(TYPE.finditer(code))
    starts = [f.start() for f in methods]
    for t, following in zip(types, [*types[1:], None]):
        k = bisect_left(heads, t.end())
        if k == len(heads) or code[heads[k]] != "{" or (following and following.start() < heads[k]):
            continue
        brace, floor = heads[k], heads[bisect_left(heads, t.start()) - 1] + 1 if bisect_left(heads, t.start()) else 0
        words, begin = [], t.start()
        for w in reversed(list(re.finditer(r"\S+", code[floor : t.start()]))):
            if w[0] not in TYPE_MODIFIERS:
                break
            words, begin = [w[0], *words] if len(words) < 10 else words, floor + w.start()
        begin, end = annotations_before(code, floor, begin), close(brace)
        m = {1: words, 2: t[1], 3: t[2], 4: re.sub(r"^\s*<[^{]*?>(?=\s|$)", "", code[t.end() : brace])}
        content, name = text[begin:end], m[3]
        extends, implements = re.search(r"extends\s+([\w.<>]+)", m[4]), re.search(r"implements\s+([\w.<>, ]+)", m[4])
        kind = "interface" if m[2] == "interface" else "class"
        out.append(row(path, "java", line(begin), line(end - 1), content, None, name, "Unknown" if kind == "interface" else spring_layer(name, content), type=kind, package=package and package[1], modifiers=m[1], extends=extends and extends[1], implements=implements and [x.strip() for x in implements[1].split(",")]))
        if kind == "interface":
            continue
        for f in methods[bisect_left(starts, brace + 1) : bisect_left(starts, end)]:
            header = header_of(code, f.start(), brace + 1, marks)
            if header is None or f[1] in NOT_NAMES:
                continue
            first, words = header
            modifiers, kind_of = [w for w in words if w in MODIFIERS], " ".join(w for w in words if w not in MODIFIERS)
            kind_of = re.sub(r"^<[^>]*>\s*", "", kind_of)
            if not RETURNS.fullmatch(kind_of) or kind_of.split()[0] in NOT_TYPES:
                continue
            stop = close(f.end() - 1)
            names = parameter_names(f[2])
            out.append(row(path, "java", line(first), line(stop - 1), text[first:stop], f[1], name, spring_layer(name, ""), type="method", return_type=kind_of, parameters=names, modifiers=modifiers, package=package and package[1]))
    once = {c[:9]: c for c in reversed(out)}  # a method of a nested class is found from both
    return list(reversed(once.values())) or java_by_indent(path, text, code) or lines_of(path, text, "java")


#: Lines that begin a type or a method in sources that braces don't explain.
TYPE_LINE = re.compile(r"\s*+(?:@\w++(?:\([^()]*+\))?+\s*+)*+(?:(?:public|protected|private|static|final|abstract|sealed)\s++)*+(class|interface|enum|record)\s++(\w++)")
METHOD_LINE = re.compile(r"\s*+(?:@\w++(?:\([^()]*+\))?+\s*+)*+((?:[\w<>\[\],.?&]++\s++)++)(\w++)\s*+\(([^()]*+)\)\s*+(?:throws\s[^{;]*+)?+\{?+\s*+$")


def indent_ends(indents: list[int | None]) -> list[int]:
    """After each line the first one that is indented no deeper; found from the end with a stack."""
    ends, stack = [len(indents)] * len(indents), []
    for n in range(len(indents) - 1, -1, -1):
        if indents[n] is not None:
            while stack and indents[stack[-1]] > indents[n]:
                stack.pop()
            ends[n] = stack[-1] if stack else len(indents)
            stack.append(n)
    return ends


def java_by_indent(path: str, text: str, code: str) -> list[tuple]:
    """Types and methods of Java with unbalanced braces or without a type: a block ends before the first line that is indented no deeper, or with it if that is a brace."""
    lines, plain, out, owners = text.split("\n"), code.split("\n"), [], []
    ends = indent_ends([len(x) - len(x.lstrip()) if x.strip() else None for x in plain])
    for n, line in enumerate(plain):
        while owners and owners[-1][0] <= n:
            owners.pop()
        kind, method = TYPE_LINE.match(line), METHOD_LINE.match(line)
        words = method[1].split() if method else []
        returns = [w for w in words if w not in MODIFIERS]
        if not kind and (not method or not returns or returns[0] in NOT_TYPES or method[2] in NOT_NAMES):
            continue
        end = ends[n] + (ends[n] < len(plain) and plain[ends[n]].lstrip().startswith("}"))
        owner, content = owners[-1][1] if owners else None, "\n".join(lines[n:end])
        if kind:
            out.append(row(path, "java", n + 1, end, content, None, kind[2], "Unknown" if kind[1] == "interface" else spring_layer(kind[2], content), type="interface" if kind[1] == "interface" else "class", parsed_by="indentation"))
            owners.append((end, kind[2]))
        else:
            out.append(row(path, "java", n + 1, end, content, method[2], owner, spring_layer(owner or "", ""), type="method", return_type=" ".join(returns), parameters=parameter_names(method[3]), modifiers=[w for w in words if w in MODIFIERS], parsed_by="indentation"))
    return out


# ---- HTML -------------------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTROL = ("th:each", "th:if", "th:unless", "th:switch", "th:case")


class Elements(HTMLParser):
    """Elements with their true line ranges, fields, headers and template attributes."""

    def __init__(self):
        super().__init__()
        self.open: list[dict] = []
        self.done: list[dict] = []

    def handle_starttag(self, tag, attrs):
        e = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "start": self.getpos()[0], "end": self.getpos()[0], "fields": [], "th": 0}
        for up in self.open:
            if up["tag"] == "form" and tag in ("input", "select", "textarea"):
                up["fields"].append(f"{e['attrs'].get('name', '')}:{e['attrs'].get('type', tag)}:{e['attrs'].get('id', '')}:{'required' in e['attrs']}")
            up["th"] += up["tag"] == "table" and tag == "th"
        self.done.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1]["tag"] == tag and tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                for e in self.open[k:]:
                    e["end"] = self.getpos()[0]
                del self.open[k:]
                return

    def close(self):
        super().close()
        for e in self.open:
            e["end"] = self.getpos()[0]


def html_chunks(path: str, text: str) -> list[tuple]:
    """Template fragments, forms, tables and control sections; lines if there are none."""
    parser = Elements()
    parser.feed(text)
    parser.close()
    lines, out, seen = text.split("\n"), [], {"form": 0, "table": 0}
    for e in parser.done:
        a, kinds = e["attrs"], []
        th = [f"{k}={v}" for k, v in a.items() if k.startswith(("th:", "data-th-"))]
        if "th:fragment" in a:
            kinds.append(("fragment", f"fragment_{a['th:fragment']}", {}))
        if e["tag"] in seen:
            n, seen[e["tag"]] = seen[e["tag"]], seen[e["tag"]] + 1
            more = {"action": a.get("action", a.get("th:action", "")), "method": a.get("method", "GET"), "fields": e["fields"]} if e["tag"] == "form" else {"column_count": e["th"]}
            kinds.append((e["tag"], a.get("id") or f"{e['tag']}_{n}", more))
        kinds += [("control", f"{c.replace(':', '_')}_{a.get('id') or e['tag']}", {}) for c in CONTROL if c in a]
        out += [row(path, "html", e["start"], e["end"], "\n".join(lines[e["start"] - 1 : e["end"]]), name, None, "Template", element_type=kind, template_attributes=th, **more) for kind, name, more in kinds]
    return out or lines_of(path, text, "html")


#: Parsers by suffix; :func:`register_parser` adds to them.
PARSERS: dict[str, Callable[[str, str], list[tuple]]] = {
    ".java": java_chunks, ".py": python_chunks, ".pyw": python_chunks, ".html": html_chunks, ".htm": html_chunks,
    **{s: (lambda path, text, lang=lang: lines_of(path, text, lang)) for s, lang in ((".kt", "kotlin"), (".kts", "kotlin"), (".xml", "xml"), (".yaml", "yaml"), (".yml", "yaml"), (".properties", "properties"))},
}


Parser = Callable[[str, str], list[tuple]]


def register_parser(suffix: str, parser: Parser) -> None:
    """Let files with this suffix go through a parser of the user's own: (path, text) to rows made by :func:`row`."""
    if not re.fullmatch(r"\.[^./]+", suffix):
        raise ValueError(f"{suffix!r} is no suffix")
    PARSERS[suffix.lower()] = parser


def chunk_file(path: str, text: str, parsers: dict[str, Parser] | None = None) -> list[tuple]:
    """Chunks of a file by the parser of its suffix."""
    suffix = re.search(r"\.[^./]+$", path.lower())
    return (PARSERS if parsers is None else parsers).get(suffix[0] if suffix else "", lines_of)(path, text or "")


def parse(files: DataFrame, parser: Parser | None = None) -> DataFrame:
    """Chunks of ``files`` (path, text); no shuffle. The parsers registered now are sent with the plan."""
    known = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (c for path, text in zip(batch["path"], batch["text"]) for c in (parser(path, text) if parser else chunk_file(path, text, known)))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "text").mapInPandas(run, PARSED)


def table_function(known: dict[str, Parser] | None = None):
    """The parsers as a table function of (path, text), for lateral joins."""
    table = dict(PARSERS) | (known or {})

    class Parsed:
        def eval(self, path: str, text: str):
            yield from chunk_file(path or "", text, table)

    return F.udtf(Parsed, returnType=PARSED, useArrow=True)


def register_function(spark: SparkSession, name: str = "parse_source", known: dict[str, Parser] | None = None) -> None:
    """Make the table function known to SQL: ``SELECT ... FROM files, LATERAL parse_source(path, text)``."""
    spark.udtf.register(name, table_function(known))


def metrics(files: DataFrame) -> DataFrame:
    """path and the measures of :func:`python_metrics`."""
    names = ["cyclomatic", "cognitive", "nesting", "functions", "hinted_returns", "hinted_parameters"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"path": p, **python_metrics(t or "")} for p, t in zip(batch["path"], batch["text"])], columns=["path", *names])

    return files.select("path", "text").mapInPandas(run, "path string, " + ", ".join(f"{n} double" for n in names))
