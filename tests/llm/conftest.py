import pytest

pytest.importorskip("evolvent.llm")
