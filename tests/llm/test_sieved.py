"""Paragraphs and contexts go through sieves as narrow rows; lists of keys are taken apart where they are sieved."""

from assayer.llm import paragraphs, sieve


def test_narrow_rows_through_sieves(docs, monkeypatch):
    seen, through = [], sieve.through

    def noted(rows, key, bits, wanted=True):
        seen.append((tuple(rows.columns), wanted))
        return through(rows, key, bits, wanted)

    monkeypatch.setattr(sieve, "through", noted)
    keyed = docs.selectExpr("doc_id as k_id", "xxhash64(text) as k_text", "text")
    assert paragraphs.repeated_paragraphs(keyed).count() > 0
    assert not any("n_keys" in columns or ("keys" in columns and not wanted) for columns, wanted in seen)
    seen.clear()
    assert paragraphs.repeated_passages(keyed).count() > 0
    # Contexts are grouped after the sieve of seeds, so no aggregate of all contexts goes through it.
    assert not any("many" in columns for columns, _ in seen)
