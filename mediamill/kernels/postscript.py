"""PDF functions: sampled, exponential, stitching, and the PostScript calculator, in single precision where it counts."""

from __future__ import annotations

import math
from typing import Any

import numpy as np

from ..errors import Invalid
from .pdf import Document, Op, Reader, Stream

F32 = np.float32
MOST_INSTRUCTIONS = 4096


def tokens(code: bytes) -> list[Any]:
    """A program as numbers, operator names and nested lists for its procedures."""
    r, stack = Reader(code, refs=False), [[]]
    while True:
        try:
            t = r.read()
        except Invalid:
            break
        if t == "{":
            stack.append([])
        elif t == "}":
            if len(stack) < 2:
                raise Invalid("program")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(str(t) if isinstance(t, Op) else t)
    if len(stack) != 1:
        raise Invalid("program")
    return stack[0]


def _round(x: float) -> float:
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


_UNARY = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": _round, "truncate": math.trunc, "sqrt": lambda a: math.sqrt(a) if a >= 0 else math.nan,
    "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": lambda a: math.log(a) if a > 0 else math.nan, "log": lambda a: math.log10(a) if a > 0 else math.nan,
    "cvi": math.trunc, "cvr": float, "not": lambda a: (not a) if isinstance(a, bool) else ~int(a),
}
_BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else math.nan, "idiv": lambda a, b: int(a / b) if b else 0,
    "mod": lambda a, b: math.fmod(a, b) if b else math.nan, "exp": lambda a, b: a**b, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360,
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "and": lambda a, b: (a and b) if isinstance(a, bool) else int(a) & int(b), "or": lambda a, b: (a or b) if isinstance(a, bool) else int(a) | int(b),
    "xor": lambda a, b: (a != b) if isinstance(a, bool) else int(a) ^ int(b), "bitshift": lambda a, b: int(a) << int(b) if b >= 0 else int(a) >> -int(b),
}


def run(program: list[Any], inputs: list[float]) -> list[float]:
    stack: list[Any] = [float(F32(x)) for x in inputs]
    budget = [100_000]

    def single(v: Any) -> Any:
        return v if isinstance(v, bool) else float(F32(v))

    def execute(code: list[Any]) -> None:
        i = 0
        while i < len(code):
            budget[0] -= 1
            if budget[0] < 0 or len(stack) > 1000:
                raise Invalid("program limits")
            t = code[i]
            i += 1
            if isinstance(t, list):
                word = code[i] if i < len(code) else None
                if word == "if":
                    i += 1
                    if stack.pop():
                        execute(t)
                elif isinstance(word, list) and i + 1 < len(code) and code[i + 1] == "ifelse":
                    i += 2
                    execute(t if stack.pop() else word)
                else:
                    raise Invalid("program")
            elif not isinstance(t, str):
                stack.append(t if isinstance(t, bool) else single(t))
            elif t in _UNARY:
                stack.append(single(_UNARY[t](stack.pop())))
            elif t in _BINARY:
                b, a = stack.pop(), stack.pop()
                stack.append(single(_BINARY[t](a, b)))
            elif t == "pop":
                stack.pop()
            elif t == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif t == "dup":
                stack.append(stack[-1])
            elif t == "copy":
                n = int(stack.pop())
                if n < 0 or n > len(stack):
                    raise Invalid("program stack")
                stack.extend(stack[len(stack) - n :])
            elif t == "index":
                n = int(stack.pop())
                stack.append(stack[-1 - n])
            elif t == "roll":
                j, n = int(stack.pop()), int(stack.pop())
                if n < 0 or n > len(stack):
                    raise Invalid("program stack")
                if n:
                    part = stack[len(stack) - n :]
                    stack[len(stack) - n :] = part[-j % n :] + part[: -j % n]
            else:
                raise Invalid("program operator")

    try:
        execute(program[0] if len(program) == 1 and isinstance(program[0], list) else program)
    except (IndexError, OverflowError, ValueError, TypeError):
        raise Invalid("program") from None
    return [float(v) for v in stack]


def column(program: list[Any], inputs: list):
    """A calculator program of plain arithmetic as Spark columns, by running it on a stack of them; branches become choices."""
    from pyspark.sql import functions as F

    unary = {"abs": F.abs, "neg": lambda a: -a, "ceiling": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)), "ln": F.log, "log": F.log10, "cvr": lambda a: a.cast("double"), "cvi": lambda a: a.cast("long"), "truncate": lambda a: a.cast("long").cast("double"), "not": lambda a: ~a}
    binary = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "exp": F.pow, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b}

    def execute(code: list[Any], stack: list) -> list:
        i = 0
        while i < len(code):
            t = code[i]
            i += 1
            if isinstance(t, list):
                test = stack.pop()
                if i < len(code) and code[i] == "if":
                    i += 1
                    one, two = execute(t, list(stack)), list(stack)
                elif i + 1 < len(code) and code[i + 1] == "ifelse":
                    one, two = execute(t, list(stack)), execute(code[i], list(stack))
                    i += 2
                else:
                    raise Invalid("program")
                if len(one) != len(two):
                    raise Invalid("program branches")
                stack = [a if a is b else F.when(test, a).otherwise(b) for a, b in zip(one, two, strict=True)]
            elif not isinstance(t, str):
                stack.append(F.lit(t if isinstance(t, bool) else float(t)))
            elif t in unary:
                stack.append(unary[t](stack.pop()))
            elif t in binary:
                b, a = stack.pop(), stack.pop()
                stack.append(binary[t](a, b))
            elif t == "pop":
                stack.pop()
            elif t == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif t == "dup":
                stack.append(stack[-1])
            else:
                raise Invalid("program operator")
        return stack

    return execute(program[0] if len(program) == 1 and isinstance(program[0], list) else program, list(inputs))


def _pairs(v: list[float]) -> list[tuple[float, float]]:
    return list(zip(v[::2], v[1::2], strict=False))


def _within(values, ranges):
    return [min(max(v, a), b) for v, (a, b) in zip(values, ranges, strict=False)] if ranges else list(values)


def evaluate(doc: Document, obj: Any, inputs: list[float], depth: int = 0) -> list[float]:
    """A function object's outputs."""
    obj = doc.get(obj)
    d = obj.dict if isinstance(obj, Stream) else obj
    if not isinstance(d, dict) or depth > 16:
        raise Invalid("function")
    d = {k: doc.get(v) for k, v in d.items()}
    domain, out_range = _pairs(d.get("Domain", [])), _pairs(d.get("Range", []))
    x = _within(inputs, domain)
    kind = d.get("FunctionType")
    if kind == 2:
        c0, c1, n = d.get("C0", [0.0]), d.get("C1", [1.0]), float(d.get("N", 1))
        t = x[0] if n == 1 else x[0] ** n if x[0] or n > 0 else math.inf
        out = [a + t * (b - a) for a, b in zip(c0, c1, strict=True)]
    elif kind == 3:
        bounds, parts, enc = d.get("Bounds", []), d["Functions"], _pairs(d["Encode"])
        k = sum(1 for b in bounds if x[0] >= b)
        k = min(k, len(parts) - 1)
        edges = [domain[0][0], *bounds, domain[0][1]]
        lo, hi = edges[k], edges[k + 1]
        t = enc[k][0] if lo == hi else enc[k][0] + (x[0] - lo) * (enc[k][1] - enc[k][0]) / (hi - lo)
        out = evaluate(doc, parts[k], [t], depth + 1)
    elif kind == 4 and isinstance(obj, Stream):
        n = len(out_range)
        out = run(tokens(doc.decode(obj)), x)[-n:] if n else []
    elif kind == 0 and isinstance(obj, Stream):
        out = sampled(doc.decode(obj), d, x, domain, out_range)
    else:
        raise Invalid("function")
    return _within(out, out_range)


def sampled(data: bytes, d: dict, x: list[float], domain, out_range) -> list[float]:
    """Values between samples on a grid, multilinear."""
    size, bits, n = d["Size"], int(d["BitsPerSample"]), len(out_range)
    enc = _pairs(d.get("Encode") or [v for s in size for v in (0, s - 1)])
    dec = _pairs(d.get("Decode") or [v for r in out_range for v in r])
    total = int(np.prod(size)) * n
    if bits not in (1, 2, 4, 8, 12, 16, 24, 32) or total > 1 << 24 or len(data) * 8 < total * bits:
        raise Invalid("function samples")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=total * bits).reshape(total, bits)
    values = (flat.astype(np.float64) * 2.0 ** np.arange(bits - 1, -1, -1)).sum(axis=1) / (2.0**bits - 1)
    grid = values.reshape(*reversed(size), n)
    at = []
    for v, (a, b), (e0, e1), s in zip(x, domain, enc, size, strict=True):
        t = e0 if a == b else e0 + (v - a) * (e1 - e0) / (b - a)
        at.append(min(max(t, 0), s - 1))
    out = np.zeros(n)
    for corner in range(1 << len(at)):
        w, place = 1.0, []
        for k, t in enumerate(at):
            low = min(int(t), size[k] - 1)
            up = corner >> k & 1
            w *= t - low if up else 1 - (t - low)
            place.append(min(low + up, size[k] - 1))
        if w:
            out += w * grid[tuple(reversed(place))]
    return [lo + v * (hi - lo) for v, (lo, hi) in zip(out, dec, strict=True)]
