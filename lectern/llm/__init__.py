"""Operators for large training-data pipelines. Nothing else in the library imports this subpackage.

pii, packing, ann, langid, secrets, toxicity, ppm, chat, decontam, simhash, hardneg, mixture and resample hold one operator each;
``queries`` registers a thin digest query for every operator.
"""
