"""No name is defined twice in a module: the later one would hide the earlier."""

import ast
from collections import Counter
from pathlib import Path

import pytest

import lodestar


@pytest.mark.parametrize("path", sorted(Path(lodestar.__file__).parent.rglob("*.py")), ids=lambda p: p.stem)
def test_no_definition_hides_another(path):
    def bodies(tree):
        for node in ast.walk(tree):
            if isinstance(node, (ast.Module, ast.ClassDef)):
                yield node.body

    for body in bodies(ast.parse(path.read_text())):
        names = Counter(n.name for n in body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        assert not [n for n, c in names.items() if c > 1]
