import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["ahocorasick", "xxhash", "public_tokenizers", "claimcheck.llm"])
def test_queries_are_listed_without_what_the_optional_part_needs(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); print('verdicts' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()[-1] == "True"
