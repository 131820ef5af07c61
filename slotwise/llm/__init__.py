"""Operators that prepare language-model training data.

Each module holds one operator: chat rendering, secret scans, sequence packing, embedding
near-duplicates, hidden Markov scoring, SimHash near-duplicates, repeated substrings, benchmark
decontamination, toxicity, and token files.  ``queries`` registers one query per operator.
Nothing else in the library imports this package.

Rules that hold for every operator unless its docstring says otherwise: a null text counts as the
empty text, null ids are kept and come back as null, repeated rows are separate documents, an empty
table gives an empty result, and columns the operator does not know are ignored, whatever their names.
"""
