"""Pure functions from Python source to numbers; no Spark here. One parse and one tokenisation a text serve all: the
kernels of a text are called one after the other, and the last few texts' sources are kept."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LAYOUT = {tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING, tokenize.COMMENT}
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_WORK = (ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Call, ast.Subscript, ast.Return, *_LOOPS)


@dataclass
class Source:
    code: str
    tree: ast.Module | None = None
    failure: str | None = None
    tokens: list[tokenize.TokenInfo] = field(default_factory=list)
    nodes: list[tuple[ast.AST, int]] = field(default_factory=list)

    @cached_property
    def functions(self) -> list[ast.AST]:
        return sorted((n for n, _ in self.nodes if isinstance(n, _FUNCTIONS)), key=lambda n: (n.lineno, n.col_offset))

    @cached_property
    def classes(self) -> list[ast.ClassDef]:
        return sorted((n for n, _ in self.nodes if isinstance(n, ast.ClassDef)), key=lambda n: (n.lineno, n.col_offset))

    @cached_property
    def points(self) -> list[int]:
        """Cognitive points of each function."""
        return [cognitive(f) for f in self.functions]

    @cached_property
    def lines(self) -> dict:
        return _lines(self)


@lru_cache(maxsize=4)
def source(code: str) -> Source:
    out = Source(code)
    if not code or not code.strip():
        return out
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return out
    except (RecursionError, MemoryError) as e:
        out.failure = type(e).__name__
        return out
    todo: list[tuple[ast.AST, int]] = [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        out.nodes.append((node, depth))
        node.kids = list(ast.iter_child_nodes(node))
        todo += [(x, depth + 1) for x in node.kids]
    try:
        out.tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError):
        out.tokens = []
    out.tree = tree
    return out


def _kids(node: ast.AST) -> list[ast.AST]:
    """The children of a node: as `source` kept them, since finding them is most of a walk."""
    try:
        return node.kids
    except AttributeError:
        return list(ast.iter_child_nodes(node))


def _walk(node: ast.AST) -> list[ast.AST]:
    out = [node]
    for x in out:
        out += _kids(x)
    return out


def _own(node: ast.AST) -> list[ast.AST]:
    """The nodes of a function or module without those of functions and classes in it."""
    out, todo = [], list(_kids(node))
    while todo:
        x = todo.pop()
        if isinstance(x, (*_FUNCTIONS, ast.ClassDef)):
            continue
        out.append(x)
        todo += _kids(x)
    return out


def mccabe(node: ast.AST, boolean: bool = True) -> int:
    n = 1
    for x in _own(node):
        if isinstance(x, (ast.If, ast.IfExp, ast.ExceptHandler, ast.Assert, *_LOOPS)):
            n += 1 if boolean or not isinstance(x, ast.Assert) else 0
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
        elif isinstance(x, ast.BoolOp) and boolean:
            n += len(x.values) - 1
        elif isinstance(x, ast.match_case):
            n += 1
    return n


def _lines(s: Source) -> dict:
    lines = s.code.splitlines()
    comments = {t.start[0] for t in s.tokens if t.type == tokenize.COMMENT}
    only = {t.start[0] for t in s.tokens if t.type == tokenize.COMMENT and not t.line[: t.start[1]].strip()}
    docs = [(n.lineno, n.end_lineno) for n, _ in s.nodes if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)]
    multi = {k for a, b in docs if b > a for k in range(a, b + 1)}
    single = {a for a, b in docs if a == b}
    blank = {k for k, x in enumerate(lines, 1) if not x.strip()}
    multi -= blank
    lloc = sum(isinstance(n, (ast.stmt, ast.comprehension)) for n, _ in s.nodes)
    return {"total": len(lines), "blank": len(blank), "comments": len(comments), "single": len(only | (single - multi)), "multi": len(multi), "sloc": len(lines) - len(blank) - len(multi) - len((only | single) - multi), "lloc": lloc, "docstring": sum(b - a + 1 for a, b in docs)}


def five_op(code: str) -> dict:
    s = source(code)
    operators, operands = [], []
    for n, _ in s.nodes:
        if isinstance(n, (ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.AugAssign)):
            operators.append(type(n.op).__name__)
            operands += [n.left, n.right] if isinstance(n, ast.BinOp) else [n.operand] if isinstance(n, ast.UnaryOp) else n.values if isinstance(n, ast.BoolOp) else [n.target, n.value]
        elif isinstance(n, ast.Compare):
            operators += [type(o).__name__ for o in n.ops]
            operands += [n.left, *n.comparators]
    names = [x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else repr(x.value) if isinstance(x, ast.Constant) else f"{type(x).__name__}@{x.lineno}:{x.col_offset}" for x in operands]
    blocks = [mccabe(n) for n in s.functions] + [1 + sum(mccabe(m) for m in c.body if isinstance(m, _FUNCTIONS)) for c in s.classes]
    module = mccabe(s.tree)
    at = s.lines
    return {
        "lloc": at["lloc"], "sloc": at["sloc"], "comments": at["comments"], "single_comments": at["single"], "multi_line_comments": at["multi"], "blank_lines": at["blank"], "total_lines": at["total"],
        "cc_sum": sum(blocks) if blocks else module, "cc_n": len(blocks) or 1, "cyclomatic_complexity_max": max(blocks, default=module), "cyclomatic_complexity_module": module, "cc_imputed_module_level": not blocks,
        "halstead_h1": len(set(operators)), "halstead_h2": len(set(names)), "halstead_n1": len(operators), "halstead_n2": len(names),
    }


_BRANCH = {"if", "elif", "for", "while", "and", "or", "except", "assert"}


def function_rows(code: str) -> list[dict]:
    """One row a function: the token reading, with cognitive points. Tokens lie in order, so a function's are a slice."""
    s = source(code)
    plain = [t for t in s.tokens if t.type not in _LAYOUT]
    starts, lines = [t.start for t in plain], [t.end[0] for t in plain]
    out = []
    for f, points in zip(s.functions, s.points, strict=True):
        own = plain[bisect_left(starts, (f.lineno, f.col_offset)) : bisect_right(lines, f.end_lineno)]
        operators = [t.string for t in own if t.type == tokenize.OP or t.type == tokenize.NAME and keyword.iskeyword(t.string)]
        operands = [t.string for t in own if not (t.type == tokenize.OP or t.type == tokenize.NAME and keyword.iskeyword(t.string))]
        a = f.args
        out.append({
            "name": f.name, "start_line": f.lineno, "end_line": f.end_lineno, "nloc": len({t.start[0] for t in own}), "token_count": len(own),
            "param_count": len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg), "cyclomatic_complexity": 1 + sum(t.string in _BRANCH for t in own if t.type == tokenize.NAME),
            "max_nesting_depth": nesting(f), "h1": len(set(operators)), "h2": len(set(operands)), "n1": len(operators), "n2": len(operands), "length": f.end_lineno - f.lineno + 1, "top": f.col_offset // 4, "cognitive_complexity": points, "plain_complexity": mccabe(f, boolean=False),
        })
    return out


def token(code: str) -> dict:
    s = source(code)
    plain = [t for t in s.tokens if t.type not in _LAYOUT]
    return {"nloc": len({k for t in plain for k in range(t.start[0], t.end[0] + 1)}), "token_count": len(plain)}


def nesting(f: ast.AST) -> int:
    deep = 0
    todo = [(x, 0) for x in _kids(f)]
    while todo:
        x, d = todo.pop()
        if isinstance(x, (*_FUNCTIONS, ast.ClassDef)):
            continue
        if isinstance(x, (ast.If, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match, *_LOOPS)):
            d += 1
            deep = max(deep, d)
        todo += [(y, d) for y in _kids(x)]
    return deep


def cognitive(node: ast.AST) -> int:
    """Points by Campbell (2018): a break of the flow costs one, and one more for each level it is nested in."""
    total = 0
    todo: list[tuple[ast.AST, int, bool]] = [(x, 0, False) for x in _kids(node)]
    while todo:
        x, depth, chained = todo.pop()
        if isinstance(x, ast.If):
            total += 1 if chained else 1 + depth
            todo += [(x.test, depth, False), *((y, depth + 1, False) for y in x.body)]
            if len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If):
                todo.append((x.orelse[0], depth, True))
            elif x.orelse:
                total += 1
                todo += [(y, depth + 1, False) for y in x.orelse]
            continue
        if isinstance(x, (*_LOOPS, ast.ExceptHandler, ast.IfExp, ast.Match)):
            total += 1 + depth
            if isinstance(x, _LOOPS) and x.orelse:
                total += 1
            depth += 1
        elif isinstance(x, ast.BoolOp):
            total += 1
        elif isinstance(x, (*_FUNCTIONS, ast.Lambda)):
            depth += 1
        todo += [(y, depth, False) for y in _kids(x)]
    return total


def _called(node: ast.Call) -> str | None:
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def _base(node: ast.expr) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def tree(code: str) -> dict:
    s = source(code)
    kinds = Counter(type(n).__name__ for n, _ in s.nodes)
    total = len(s.nodes)
    found = s.classes
    local = {c.name for c in found}
    bases = {c.name: [b for b in map(_base, c.bases) if b in local and b != c.name] for c in found}
    depth: dict[str, int] = {}
    for name in bases:  # iterative, each class once; a cycle counts as a root
        stack, path = [name], set()
        while stack:
            x = stack[-1]
            open_ = [b for b in bases[x] if b not in depth and b not in path and b != x]
            path.add(x)
            if open_:
                stack.append(open_[0])
            else:
                depth[x] = 1 + max((depth.get(b, 0) for b in bases[x]), default=0)
                path.discard(x)
                stack.pop()
    methods = [[m.name for m in c.body if isinstance(m, _FUNCTIONS)] for c in found]
    rfc = [len(m) + len({n for x in _walk(c) if isinstance(x, ast.Call) and (n := _called(x))} - set(m)) for c, m in zip(found, methods, strict=True)]
    children = Counter(b for own in bases.values() for b in set(own))
    dit = [depth[c.name] for c in found]
    return {
        "ast_depth": max(d for _, d in s.nodes), "total_nodes": total, "functiondef_count": kinds["FunctionDef"] + kinds["AsyncFunctionDef"], "classdef_count": kinds["ClassDef"], "return_count": kinds["Return"], "call_count": kinds["Call"],
        "assign_count": kinds["Assign"] + kinds["AugAssign"] + kinds["AnnAssign"], "comprehension_count": sum(kinds[k.__name__] for k in _COMPREHENSIONS), "try_count": kinds["Try"],
        "decorator_count": sum(len(n.decorator_list) for n, _ in s.nodes if isinstance(n, (*_FUNCTIONS, ast.ClassDef))), "loops": kinds["For"] + kinds["While"] + kinds["AsyncFor"], "ifs": kinds["If"], "imports": kinds["Import"] + kinds["ImportFrom"],
        "class_count": len(found), "dit": dit, "noc_max": max((children[c] for c in local), default=None), "rfc": rfc, "methods": [len(m) for m in methods],
        "base_classes_external": sum(1 for c in found for b in map(_base, c.bases) if b and b not in local and b != "object"), "operational_node_count": sum(isinstance(n, _WORK) for n, _ in s.nodes),
    }


def lexical(code: str) -> dict:
    s = source(code)
    plain = [t for t in s.tokens if t.type not in _LAYOUT]
    nodes = [n for n, _ in s.nodes]
    imports = {a.name for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names} | {n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module}
    return {
        "distinct_tokens": len({t.string for t in plain}), "lexical_tokens": len(plain), "distinct_identifiers": len({t.string for t in plain if t.type == tokenize.NAME and not keyword.iskeyword(t.string)}),
        "distinct_variables": len({n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.arg for n in nodes if isinstance(n, ast.arg)}), "distinct_functions_defined": len({n.name for n in nodes if isinstance(n, _FUNCTIONS)}),
        "distinct_calls": len({c for n in nodes if isinstance(n, ast.Call) and (c := _called(n))}), "distinct_attributes": len({n.attr for n in nodes if isinstance(n, ast.Attribute)}), "distinct_imports": len(imports),
    }


def _unreachable(body: list[ast.stmt]) -> int:
    ends = next((i for i, x in enumerate(body) if isinstance(x, (ast.Return, ast.Raise, ast.Break, ast.Continue))), None)
    return int(ends is not None and ends + 1 < len(body))


def _lcom(c: ast.ClassDef) -> int:
    """Connected components of methods that share attributes of self or call each other (Hitz and Montazeri 1995)."""
    uses = {m.name: {x.attr for x in _walk(m) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self"} for m in c.body if isinstance(m, _FUNCTIONS)}
    names, parent = list(uses), {n: n for n in uses}

    def root(n: str) -> str:
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if uses[a] & uses[b] or a in uses[b] or b in uses[a]:
                parent[root(a)] = root(b)
    return len({root(n) for n in names}) or 1


def _shape(f: ast.AST) -> Counter:
    return Counter(f"{type(n).__name__}>{type(m).__name__}" for n in _walk(f) for m in _kids(n))


def structure(code: str, similar: float = 0.85, least_nodes: int = 12) -> dict:
    s = source(code)
    found, fs, at = s.classes, s.functions, s.lines
    names = {c.name for c in found}
    cbo = [len({n.id for n in _walk(c) if isinstance(n, ast.Name) and n.id[:1].isupper() and n.id != c.name} | {n.attr for n in _walk(c) if isinstance(n, ast.Attribute) and n.attr in names}) for c in found]
    bodies = [b for n, _ in s.nodes for name in ("body", "orelse", "finalbody") if isinstance(b := getattr(n, name, None), list) and b]
    shapes = [x for x in map(_shape, fs) if x.total() >= least_nodes]
    kinds = Counter(frozenset(x.items()) for x in shapes)  # like functions are one shape, so that they aren't compared
    distinct = sorted(((dict(k), sum(n for _, n in k), many) for k, many in kinds.items()), key=lambda x: x[1])
    group, pairs, alike = list(range(len(distinct))), 0, 0.0

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    linked = {i for i, (_, _, many) in enumerate(distinct) if many > 1}
    for i, (x, size, many) in enumerate(distinct):
        pairs += many * (many - 1) // 2
        alike += many * (many - 1) // 2
        j = i + 1
        while j < len(distinct) and size >= similar * distinct[j][1]:  # sizes ascend
            y, other, more = distinct[j]
            both = sum(min(n, y.get(k, 0)) for k, n in x.items())
            share = both / (size + other - both)
            if share >= similar:
                pairs += many * more
                alike += many * more * share
                linked |= {i, j}
                group[root(i)] = root(j)
            j += 1
    return {
        "cbo": cbo, "lcom": [_lcom(c) for c in found], "class_count": len(found), "dead_code_findings": sum(map(_unreachable, bodies)), "blocks": len(bodies), "clone_count": sum(distinct[i][2] for i in linked), "clone_pairs": pairs, "clone_groups": len({root(i) for i in linked}),
        "similarity": alike if pairs else None, "clone_fragments_analysed": len(shapes), "function_count": len(fs), "sloc": at["sloc"], "lloc": sum(isinstance(n, ast.stmt) for n, _ in s.nodes), "comment_lines": at["comments"], "docstring_lines": at["docstring"],
    }


def unused(code: str) -> dict:
    """Definitions that nothing in the text names; imports and unreachable code are certain, the rest 60 percent."""
    s = source(code)
    nodes = [n for n, _ in s.nodes]
    used = {n.id for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} | {n.attr for n in nodes if isinstance(n, ast.Attribute)}
    found = [90 for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names if (a.asname or a.name.split(".")[0]) not in used and a.name != "*"]
    found += [60 for n in nodes if isinstance(n, (*_FUNCTIONS, ast.ClassDef)) and n.name not in used and not n.name.startswith("__")]
    found += [60 for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and n.id not in used and not n.id.startswith("_")]
    found += [100 for n in nodes for name in ("body", "orelse", "finalbody") if isinstance(b := getattr(n, name, None), list) and b and _unreachable(b)]
    return {"found": found}


#: Called name -> (severity, confidence); a documented subset of what security linters look for.
_RISKS = {"eval": ("MEDIUM", "HIGH"), "exec": ("MEDIUM", "HIGH"), "md5": ("HIGH", "HIGH"), "sha1": ("HIGH", "HIGH"), "system": ("HIGH", "HIGH"), "popen": ("HIGH", "HIGH"), "loads": ("MEDIUM", "HIGH"), "mktemp": ("MEDIUM", "HIGH"), "Telnet": ("HIGH", "HIGH"), "randint": ("LOW", "HIGH"), "random": ("LOW", "HIGH")}


def security(code: str) -> dict:
    found = []
    for n, _ in source(code).nodes:
        if isinstance(n, ast.Call):
            name, f = _called(n), n.func
            owner = f.value.id if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) else None
            if name in _RISKS and (name in ("eval", "exec") and owner is None or owner in ("hashlib", "os", "pickle", "marshal", "tempfile", "telnetlib", "random")):
                found.append(_RISKS[name])
            if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords):
                found.append(("HIGH", "HIGH"))
        elif isinstance(n, ast.Assert):
            found.append(("LOW", "HIGH"))
        elif isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and any("password" in (_base(t) or "").lower() for t in n.targets):
            found.append(("LOW", "MEDIUM"))
        elif isinstance(n, (ast.Import, ast.ImportFrom)) and any(a.name in ("pickle", "subprocess", "telnetlib", "marshal") for a in n.names):
            found.append(("LOW", "HIGH"))
    return {"severity": [a for a, _ in found], "confidence": [b for _, b in found]}


def whole_cognitive(code: str) -> dict:
    s = source(code)
    inner = s.points
    return {"cognitive_complexity": cognitive(ast.Module([x for x in s.tree.body if not isinstance(x, (*_FUNCTIONS, ast.ClassDef))], [])) + sum(inner), "points": inner}
