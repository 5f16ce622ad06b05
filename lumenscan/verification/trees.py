"""Small step trees written by hand, flattened to rows of the step table."""

from __future__ import annotations

STEP_DDL = (
    "unit_id string, fn_no int, fn_name string, step_no int, sub_end int, parent_no int, branch string, "
    "ordinal int, kind string, label string, condition string, header string, signature string, "
    "n_then int, n_else int, n_body int, line int"
)
FUNCTION_DDL = (
    "unit_id string, fn_no int, fn_name string, container string, signature string, line int, start int, stop int"
)


def act(label):
    return {"kind": "action", "label": label}


def when(condition, then=(), other=()):
    return {"kind": "if", "condition": condition, "then": list(then), "else": list(other)}


def loop_while(condition, *body):
    return {"kind": "while", "condition": condition, "body": list(body)}


def loop_in(header, *body):
    return {"kind": "for_in", "header": header, "body": list(body)}


def loop_num(header, *body):
    return {"kind": "numeric_for", "header": header, "body": list(body)}


def loop_until(condition, *body):
    return {"kind": "repeat_until", "condition": condition, "body": list(body)}


def closure(label, *body, signature="function()"):
    return {"kind": "closure", "label": label, "signature": signature, "body": list(body)}


def flatten(steps) -> list[dict]:
    """Preorder rows with step_no, sub_end, parent_no, branch and ordinal."""
    rows: list[dict] = []

    def visit(sequence, parent, branch):
        for ordinal, node in enumerate(sequence):
            row = {
                "step_no": len(rows), "parent_no": parent, "branch": branch, "ordinal": ordinal,
                "kind": node["kind"], "label": node.get("label"), "condition": node.get("condition"),
                "header": node.get("header"), "signature": node.get("signature"),
                "n_then": len(node.get("then", ())), "n_else": len(node.get("else", ())),
                "n_body": len(node.get("body", ())),
            }
            rows.append(row)
            for part in ("then", "else", "body"):
                visit(node.get(part, ()), row["step_no"], part)
            row["sub_end"] = len(rows) - 1

    visit(steps, None, "body")
    return rows


def step_rows(functions: dict[str, list], unit_id: str = "u") -> list[tuple]:
    """Rows of ``STEP_DDL`` for ``{function name: steps}``."""
    out = []
    for fn_no, (name, steps) in enumerate(functions.items()):
        for r in flatten(steps):
            out.append((
                unit_id, fn_no, name, r["step_no"], r["sub_end"], r["parent_no"], r["branch"], r["ordinal"],
                r["kind"], r["label"], r["condition"], r["header"], r["signature"],
                r["n_then"], r["n_else"], r["n_body"], 1,
            ))
    return out


def function_rows(functions: dict[str, list], unit_id: str = "u") -> list[tuple]:
    return [(unit_id, n, name, None, "", 1, 0, 0) for n, name in enumerate(functions)]
