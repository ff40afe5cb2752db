"""Operators for preparing training data. Nothing else in the library imports them.

pii         personal data spans by anchor expansion
langid      language spans by script ranges and Viterbi
suffixes    repeated passages by a logarithmic family of suffix arrays
ppm         language-model score by partial matching
rules       learned decision list over text statistics
bpe         byte-level encoding and decoding
toxicity    compression distance to two dictionaries
mixing      sources mixed to target weights
simhash     near-duplicate texts by covering-code anchors
lattice     near-duplicate vectors by E8 lattice cells
phrases     collocations from depth-truncated suffix subtrees
search      ranked lexical search by two trees with coordinate maxima
neighbours  quality by votes of the nearest labelled documents
"""
