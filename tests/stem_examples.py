"""Word pairs printed as examples in the published algorithm."""

STEP_EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz",
    "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "rational": "ration",
    "relational": "relat", "conditional": "condit", "hopefulness": "hope", "triplicate": "triplic",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "adoption": "adopt", "effective": "effect", "rate": "rate",
    "probate": "probat", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}

# Words and stems from the published description of the later algorithm.
LATER_WORDS = """consign consigned consigning consignment consist consisted consistency consistent consistently consolation
consolations consolatory console consoled consolidate consolidated consolingly conspicuous conspiracy conspirator knack
knackeries knavish kneaded kneeling knick knightly knights knitted knitting knocked knots"""
LATER_STEMS = """consign consign consign consign consist consist consist consist consist consol consol consolatori consol
consol consolid consolid consol conspicu conspiraci conspir knack knackeri knavish knead kneel knick knight knight knit knit
knock knot"""
