"""The README's usage example runs as written on plain files."""

import json
import os
import tempfile

import pyarrow.parquet as pq


def test_readme_example_runs(spark, sf):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    text = open(os.path.join(root, "README.md"), encoding="utf-8").read()
    start = text.index("```python\nfrom pyspark.sql import functions as F\nfrom docweave.session import get_session")
    code = text[start + len("```python\n"):text.index("```", start + 10)]
    d = tempfile.mkdtemp(prefix="docweave-readme-")
    os.makedirs(os.path.join(d, "help", "sub"))
    os.makedirs(os.path.join(d, "sessions"))
    pages = pq.read_table(os.path.join(sf, "pages.parquet")).to_pylist()[:10]
    for p in pages:
        name = f"sub/p{p['page_id']}.htm" if p["page_id"] % 2 else f"P{p['page_id']}.HTML"
        with open(os.path.join(d, "help", name), "w", encoding="utf-8") as f:
            f.write(p["html"])
    with open(os.path.join(d, "questions.txt"), "w") as f:
        f.write("how do I export a table\n\nwhat is the limit\n")
    with open(os.path.join(d, "sessions", "chat_session_1.json"), "w") as f:
        json.dump([{"role": "user", "content": "Export please", "timestamp": "2025-03-07T16:50:51Z"},
                   {"role": "assistant", "content": "to export, use", "timestamp": "2025-03-07T16:50:52Z"}], f)
    scope = {}
    exec(code.replace("/data", d), scope)
    assert scope["prompts"].count() == 2
    assert scope["pairs"].count() == 1
    assert scope["index"].count() > 0
