"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries.py`` holds the thin registered queries.

Shared conventions, tested in ``tests/llm``:

* a null text is the empty text, and a null id is an id like any other;
* rows that repeat both id and text are copies of one document and all get its
  result; rows that share an id but not the text are different documents;
* columns that an operator does not name are ignored, whatever they are called;
* an empty table gives an empty table of the documented schema.
"""
