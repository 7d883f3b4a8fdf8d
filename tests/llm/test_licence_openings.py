"""The real opening text of every licence is told as that licence."""

import pytest

from harborline.llm import license_scan

OPENINGS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal',
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
    "copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n",
}


@pytest.fixture(scope="module")
def told(spark):
    rows = [(k, f"d{k}/code.c", f"/* a.c, made in Oslo\n\n{text}\n\n*/\nint main() of the code\n" + "x = y\n" * 9) for k, text in enumerate(OPENINGS.values())]
    rows += [(100 + k, f"e{k}/n.txt", "The software is free for the public in some form, and use of it is wide. " * 3) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert all(got[i].origin == "none" for i in got if i >= 100)
    return {name: got[k] for k, name in enumerate(OPENINGS)}


def test_openings_of_all_licences():
    assert set(OPENINGS) == set(license_scan.TEMPLATES)


@pytest.mark.parametrize("name", OPENINGS)
def test_opening(told, name):
    assert (told[name].licence, told[name].origin) == (name, "own")


def test_texts_without_a_heavy_term_cannot_reach_the_least():
    import itertools
    import math
    import random

    rng = random.Random(1)
    for _ in range(200):
        weights = {f"t{i}": rng.random() ** 3 + 0.01 for i in range(rng.randrange(1, 9))}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        squares = {"x": {t: (w / norm) ** 2 for t, w in weights.items()}}
        heavy = set(license_scan.heavy_terms(squares, 0.7))
        for k in range(1, len(weights) + 1):
            for held in itertools.combinations(weights, k):
                if not heavy & set(held):
                    assert math.sqrt(sum(squares["x"][t] for t in held)) < 0.7
