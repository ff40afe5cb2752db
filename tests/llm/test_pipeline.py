import hashlib

import corpus_pipeline
from tokenizers import Tokenizer

from redline.llm import bpe, mixing, pii, rules, simhash
from redline.llm.common import cut, table

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    library = Tokenizer.from_file(bpe.public_vocabulary()[0])
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF))
        before, after = docs.collect(), out.collect()
        if name != "bpe":
            assert out.columns == columns
        if name == "quality_rules":
            found = rules.judge(docs, table(spark, SF, "labels"))[0].where("kept").collect()
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in found) and 0 < len(after) < len(before)
        elif name == "simhash_near_dedup":
            prints = {r.doc_id: simhash.fingerprint(r.text) for r in before}
            left, group = set(prints), {}
            while left:
                start = min(left)
                todo, seen = [start], {start}
                while todo:
                    a = todo.pop()
                    near = {b for b in left if b not in seen and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2}
                    seen |= near
                    todo += near
                group[start] = seen
                left -= seen
            assert sorted(r.doc_id for r in after) == sorted(group)
        elif name == "pii":
            assert {r.doc_id: r.text for r in after} == {r.doc_id: pii.redact(r.text) for r in before}
            assert all(not pii.find(r.text)[:1] or pii.find(r.text)[0][0] not in pii.BASE for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mix_sources":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert sorted(r.doc_id for r in after) == sorted(i for i, n in copies.items() for _ in range(n))
        else:
            assert sorted((r.doc_id, r.ids_sha256) for r in after) == sorted(
                (r.doc_id, hashlib.sha256(",".join(map(str, library.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()) for r in before)
        docs = out


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_bear_awkward_and_empty_tables(spark, awkward, empty, crowded):
    for docs in (awkward, empty, crowded):
        for _, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, docs, SF))
            assert out.count() <= 2 * docs.count()


def test_entry_without_the_package(tmp_path):
    """The rest of the library imports and lists its queries without these folders."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "redline", tmp_path / "redline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
