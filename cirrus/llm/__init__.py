"""Operators for preparing language-model training data.

Thirteen operators (quality rules, SimHash, embeddings, URL filter, line alignment,
Katz language model, toxicity segments, language id, benchmark decontamination,
byte-level BPE, source mixing, centroid clustering, token alignment), each in a module of its own with a general interface.
``queries.py`` wires each onto the shared tables.
"""
