"""The feature tables that results depend on, stated as plain text.

INVENTORY lists letters and digraphs with the words of their names; class features (sonorant, coronal
and the like) and the labels of spellings with marks (MARKED, SPELLED) follow from rules in `resolver`.
Another inventory is a parameter: see `phonospark.sources.readers`.
"""

from __future__ import annotations

# grapheme, words of its name
INVENTORY = """
a front open unrounded vowel
b bilabial consonant stop voiced
bv affricate consonant labio-dental voiced
b̪ consonant labio-dental stop voiced
bβ affricate bilabial consonant voiced
c consonant palatal stop voiceless
cç affricate consonant palatal voiceless
ç consonant fricative palatal sibilant voiceless
d alveolar consonant stop voiced
dz affricate alveolar consonant sibilant voiced
dð affricate consonant dental voiced
dɮ affricate alveolar consonant lateral voiced
dʑ affricate alveolo-palatal consonant sibilant voiced
dʒ affricate consonant post-alveolar sibilant voiced
d̠ consonant post-alveolar stop voiced
e close-mid front unrounded vowel
e̞ front mid unrounded vowel
f consonant fricative labio-dental voiceless
g consonant stop velar voiced
gǀ click consonant dental voiced
gǁ click consonant lateral voiced
gǂ click consonant palatal voiced
gǃ alveolar click consonant voiced
gǃǃ click consonant retroflex voiced
gɣ affricate consonant velar voiced
gʘ click consonant labial voiced
h consonant fricative glottal voiceless
i close front unrounded vowel
j approximant consonant palatal voiced
k consonant stop velar voiceless
kx affricate consonant velar voiceless
k̬ consonant revoiced stop velar voiced
l alveolar approximant consonant lateral voiced
l̠ approximant consonant lateral post-alveolar voiced
m bilabial consonant nasal voiced
n alveolar consonant nasal voiced
o back close-mid rounded vowel
o̞ back mid rounded vowel
p bilabial consonant stop voiceless
pf affricate consonant labio-dental voiceless
pɸ affricate bilabial consonant voiceless
p̪ consonant labio-dental stop voiceless
q consonant stop uvular voiceless
qχ affricate consonant uvular voiceless
r alveolar consonant trill voiced
s alveolar consonant fricative sibilant voiceless
t alveolar consonant stop voiceless
ts affricate alveolar consonant sibilant voiceless
tɕ affricate alveolo-palatal consonant sibilant voiceless
tɬ affricate alveolar consonant lateral voiceless
tʃ affricate consonant post-alveolar sibilant voiceless
t̠ consonant post-alveolar stop voiceless
tθ affricate consonant dental voiceless
u back close rounded vowel
v consonant fricative labio-dental voiced
w approximant consonant labio-velar voiced
x consonant fricative velar voiceless
y close front rounded vowel
z alveolar consonant fricative sibilant voiced
æ front near-open unrounded vowel
ð consonant dental fricative voiced
ð̞ approximant consonant dental voiced
ø close-mid front rounded vowel
ø̞ front mid rounded vowel
ħ consonant fricative pharyngeal voiceless
ŋ consonant nasal velar voiced
ŋǀ consonant dental nasal-click voiced
ŋǁ consonant lateral nasal-click voiced
ŋǂ consonant nasal-click palatal voiced
ŋǃ alveolar consonant nasal-click voiced
ŋǃǃ consonant nasal-click retroflex voiced
ŋʘ consonant labial nasal-click voiced
œ front open-mid rounded vowel
ǀ click consonant dental voiceless
ǁ click consonant lateral voiceless
ǂ click consonant palatal voiceless
ǃ alveolar click consonant voiceless
ȡ alveolo-palatal consonant stop voiced
ȴ alveolo-palatal approximant consonant lateral voiced
ȵ alveolo-palatal consonant nasal voiced
ȶ alveolo-palatal consonant stop voiceless
ɐ central near-open unrounded vowel
ɑ back open unrounded vowel
ɒ back open rounded vowel
ɓ bilabial consonant implosive voiced
ɔ back open-mid rounded vowel
ɕ alveolo-palatal consonant fricative sibilant voiceless
ɖ consonant retroflex stop voiced
ɖʐ affricate consonant retroflex sibilant voiced
ɗ consonant dental implosive voiced
ɘ central close-mid unrounded vowel
ə central mid unrounded vowel
ɛ front open-mid unrounded vowel
ɜ central open-mid unrounded vowel
ɞ central open-mid rounded vowel
ɞ̞ central near-open rounded vowel
ɟ consonant palatal stop voiced
ɟʝ affricate consonant palatal voiced
ɠ consonant implosive velar voiced
ɢ consonant stop uvular voiced
ɢʁ affricate consonant uvular voiced
ɣ consonant fricative velar voiced
ɤ back close-mid unrounded vowel
ɤ̞ back mid unrounded vowel
ɥ approximant consonant labio-palatal voiced
ɦ consonant fricative glottal voiced
ɧ consonant fricative palatal-velar voiceless
ɨ central close unrounded vowel
ɪ near-close near-front unrounded vowel
ɪ̈ central near-close unrounded vowel
ɬ alveolar consonant fricative lateral voiceless
ɭ approximant consonant lateral retroflex voiced
ɮ alveolar consonant fricative lateral voiced
ɯ back close unrounded vowel
ɯ̽ near-back near-close unrounded vowel
ɰ approximant consonant velar voiced
ɱ consonant labio-dental nasal voiced
ɲ consonant nasal palatal voiced
ɳ consonant nasal retroflex voiced
ɴ consonant nasal uvular voiced
ɵ central close-mid rounded vowel
ɵ̞ central mid rounded vowel
ɶ front open rounded vowel
ɸ bilabial consonant fricative voiceless
ɹ alveolar approximant consonant voiced
ɹ̠ approximant consonant post-alveolar voiced
ɺ alveolar consonant lateral tap voiced
ɻ approximant consonant retroflex voiced
ɽ consonant retroflex tap voiced
ɾ alveolar consonant tap voiced
ɿ back close unrounded vowel with-frication
ʀ consonant trill uvular voiced
ʁ consonant fricative uvular voiced
ʁ̞ approximant consonant uvular voiced
ʂ consonant fricative retroflex sibilant voiceless
ʃ consonant fricative post-alveolar sibilant voiceless
ʄ consonant implosive palatal voiced
ʅ central close unrounded vowel with-frication
ʇ̼ click consonant linguolabial voiced
ʈ consonant retroflex stop voiceless
ʈʂ affricate consonant retroflex sibilant voiceless
ʉ central close rounded vowel
ʊ near-back near-close rounded vowel
ʊ̈ central near-close rounded vowel
ʋ approximant consonant labio-dental voiced
ʌ back open-mid unrounded vowel
ʍ approximant consonant labio-velar voiceless
ʎ approximant consonant lateral palatal voiced
ʏ near-close near-front rounded vowel
ʐ consonant fricative retroflex sibilant voiced
ʑ alveolo-palatal consonant fricative sibilant voiced
ʒ consonant fricative post-alveolar sibilant voiced
ʔ consonant glottal stop voiceless
ʔh affricate consonant glottal voiceless
ʕ consonant fricative pharyngeal voiced
ʘ click consonant labial voiceless
ʙ bilabial consonant trill voiced
ʛ consonant implosive uvular voiced
ʛ̥ consonant implosive uvular voiceless
ʜ consonant epiglottal fricative voiceless
ʝ consonant fricative palatal voiced
ʟ approximant consonant lateral velar voiced
ʡ consonant epiglottal stop voiceless
ʢ consonant epiglottal fricative voiced
ʮ back close rounded vowel with-frication
ʯ central close rounded vowel with-frication
β bilabial consonant fricative voiced
β̞ approximant bilabial consonant voiced
θ consonant dental fricative voiceless
χ consonant fricative uvular voiceless
ᶑ consonant implosive retroflex voiced
ⱱ consonant labio-dental tap voiced
"""
# node, parent
NODES = """
Laryngeal Root
Manner Root
Release Manner
Place Root
Labial Place
Coronal Place
Dorsal Place
Pharyngeal Place
Shift Place
TongueRoot Root
Prosodic Root
Length Prosodic
Secondary Prosodic
Tonal Root
TonalOnset Tonal
TonalMid Tonal
TonalOffset Tonal
"""
# leaf, positive, negative, node, weight if not one over the depth
LEAVES = """
voice voiced voiceless Laryngeal
spread_glottis aspirated - Laryngeal
constricted_glottis glottalized - Laryngeal
breathy_voice breathy - Laryngeal
creaky_voice creaky - Laryngeal
voice_shift revoiced devoiced Laryngeal
pre_aspiration pre-aspirated - Laryngeal
pre_glottalization pre-glottalized - Laryngeal
strength strong - Laryngeal
ejective_feature ejective - Laryngeal
sonorant sonorant obstruent Manner
continuant continuant non-continuant Manner
nasal nasal - Manner
lateral lateral - Manner
strident sibilant - Manner
delayed_release affricate - Manner
tap_feature tap - Manner
airstream non-pulmonic - Manner
syllabic syllabic non-syllabic Manner
pre_nasalization pre-nasalized - Manner
nasal_click nasal-click - Manner
no_release unreleased - Release
nasal_release with-nasal-release - Release
lateral_release with-lateral-release - Release
fricated_release with-frication - Release
nasalized_feature nasalized - Manner
dorsal_closure dorsal-closure - Manner
round rounded unrounded Labial
rounding_degree more-rounded less-rounded Labial
anterior anterior non-anterior Coronal
distributed distributed non-distributed Coronal
tongue_blade apical laminal Coronal
front_back_shift advanced retracted Shift
height_shift raised lowered Shift
centralization centralized - Shift
mid_centralization mid-centralized - Shift
labial_articulator labial - Place 0.4
coronal_articulator coronal - Place 0.4
dorsal_articulator dorsal - Place 0.4
guttural_articulator guttural - Place 0.4
atr advanced-tongue-root retracted-tongue-root TongueRoot
labialized_feature labialized - Secondary
palatalized_feature palatalized - Secondary
pharyngealized_feature pharyngealized - Secondary
velarized_feature velarized - Secondary
labio_palatalized_feature labio-palatalized - Secondary
rhotacized_feature rhotacized - Secondary
pre_labialized_feature pre-labialized - Secondary
pre_palatalized_feature pre-palatalized - Secondary
tone_presence tone-present - Tonal
tone_neutral tone-neutral - Tonal
vocoid vocoid consonantal Root 0.8
"""
# feature, node
FEATURE_NODES = """
advanced-tongue-root TongueRoot
affricate Manner
approximant Manner
aspirated Laryngeal
breathy Laryngeal
click Manner
creaky Laryngeal
ejective Prosodic
fricative Manner
glottalized Laryngeal
implosive Manner
labialized Prosodic
labio-palatal Labial
labio-velar Labial
lateral Manner
nasal Manner
nasalized Prosodic
non-pulmonic Manner
non-syllabic Manner
palatalized Prosodic
pharyngealized Prosodic
retracted-tongue-root TongueRoot
rounded Labial
sibilant Manner
stop Manner
syllabic Manner
tap Manner
tone-present Tonal
trill Manner
unrounded Labial
voiced Laryngeal
voiceless Laryngeal
tone-neutral Tonal
"""
# scale, node, weight, default level, levels
SCALES = """
vowel_height Dorsal 1.0 - close near-close close-mid mid open-mid near-open open
vowel_backness Dorsal 0.8 - front near-front central near-back back
dorsal_place Dorsal 0.5 - palatal labio-palatal palatal-velar velar labio-velar uvular
coronal_place Coronal 0.5 - linguolabial dental alveolar post-alveolar retroflex alveolo-palatal
labial_place Labial 0.3 - bilabial labio-dental
guttural_place Pharyngeal 0.4 - pharyngeal epiglottal glottal
duration Length 0.5 1 ultra-short short mid-long long ultra-long
tone_onset_level TonalOnset 0.4 - tone-onset-1 tone-onset-2 tone-onset-3 tone-onset-4 tone-onset-5
tone_mid_level TonalMid 0.4 - tone-mid-1 tone-mid-2 tone-mid-3 tone-mid-4 tone-mid-5
tone_offset_level TonalOffset 0.4 - tone-offset-1 tone-offset-2 tone-offset-3 tone-offset-4 tone-offset-5
"""
# dimension, node, positive labels, negative labels, leaf whose weight it takes (or a weight)
DIMENSIONS = """
voice Laryngeal voiced voiceless voice
spread_glottis Laryngeal aspirated - spread_glottis
constricted_glottis Laryngeal glottalized - constricted_glottis
sonorant Manner sonorant obstruent sonorant
continuant Manner approximant|fricative affricate|stop continuant
nasal Manner nasal - nasal
lateral Manner lateral - lateral
strident Manner sibilant - strident
delayed_release Manner affricate - delayed_release
tap_feature Manner tap - tap_feature
airstream Manner non-pulmonic - airstream
syllabic Manner syllabic non-syllabic syllabic
labial Place labial - labial_articulator
round Labial rounded unrounded round
coronal Place coronal - coronal_articulator
anterior Coronal alveolar|dental alveolo-palatal|post-alveolar|retroflex anterior
distributed Coronal alveolo-palatal|post-alveolar alveolar|retroflex distributed
dorsal Place dorsal - dorsal_articulator
breathy_voice Laryngeal breathy - breathy_voice
creaky_voice Laryngeal creaky - creaky_voice
atr TongueRoot advanced-tongue-root retracted-tongue-root atr
apical Coronal apical laminal 0.3333333333333333
nasalized Manner nasalized - nasalized_feature
labialized Secondary labialized - labialized_feature
palatalized Secondary palatalized - palatalized_feature
pharyngealized Secondary pharyngealized - pharyngealized_feature
ejective Laryngeal ejective - ejective_feature
rhotacized Secondary rhotacized - rhotacized_feature
velarized Secondary velarized - velarized_feature
vocoid Root vowel consonant vocoid
voice_shift Laryngeal revoiced devoiced voice_shift
pre_aspiration Laryngeal pre-aspirated - pre_aspiration
pre_glottalization Laryngeal pre-glottalized - pre_glottalization
strength Laryngeal strong - strength
pre_nasalization Manner pre-nasalized - pre_nasalization
nasal_click Manner nasal-click - nasal_click
no_release Release unreleased - no_release
nasal_release Release with-nasal-release - nasal_release
lateral_release Release with-lateral-release - lateral_release
fricated_release Release with-frication - fricated_release
front_back_shift Shift advanced retracted front_back_shift
height_shift Shift raised lowered height_shift
centralization Shift centralized - centralization
mid_centralization Shift mid-centralized - mid_centralization
rounding_degree Labial more-rounded less-rounded rounding_degree
labio_palatalized Secondary labio-palatalized - labio_palatalized_feature
pre_labialized Secondary pre-labialized - pre_labialized_feature
pre_palatalized Secondary pre-palatalized - pre_palatalized_feature
tone_presence Tonal tone-present - tone_presence
tone_neutral Tonal tone-neutral - tone_neutral
fricative Manner fricative - 0.5
click Manner click|nasal-click - 0.5
implosive Manner implosive - 0.5
guttural Place guttural - guttural_articulator
"""
PRESETS = {
    "flat": None,
    "ignore-length": {"Length": 0.0},
    "ignore-prosodic": {"Prosodic": 0.0},
    "ignore-secondary": {"Secondary": 0.0},
    "ignore-tone": {"Tonal": 0.0},
    "segmental": {"Tonal": 0.0, "Length": 0.0},
    "tone-heavy": {"Tonal": 2.0},
    "tone-only": {"Laryngeal": 0.0, "Manner": 0.0, "Place": 0.0, "TongueRoot": 0.0, "Prosodic": 0.0},
}
COMBINING = """
0303 nasalized
0306 ultra-short
0308 centralized
030A devoiced
030D syllabic
0318 advanced-tongue-root
0319 retracted-tongue-root
031A unreleased
031C less-rounded
031D raised
031E lowered
031F advanced
0320 retracted
0324 breathy
0325 devoiced
0329 syllabic
032A dental
032C revoiced
032F non-syllabic
0330 creaky
0339 more-rounded
033A apical
033B laminal
033C linguolabial
033D mid-centralized
0348 strong
"""
SUFFIX = """
02B0 aspirated
02B1 breathy
02B2 palatalized
02B7 labialized
02BC ejective
02C0 glottalized
02D0 long
02D1 mid-long
02DE rhotacized
02E0 velarized
02E1 with-lateral-release
02E4 pharyngealized
1DA3 labio-palatalized
207F with-nasal-release
"""
PREFIX = """
02B0 pre-aspirated
02B2 pre-palatalized
02B7 pre-labialized
02C0 pre-glottalized
207F pre-nasalized
"""
TONE_MARKS = """
0300 2 2 2
0301 4 4 4
0302 4 3 2
0304 3 3 3
030B 5 5 5
030C 2 3 4
030F 1 1 1
"""
# modifier, state, columns in order of preference
VALUED_EFFECTS = """
devoiced - periodicGlottalSource voice voiced
revoiced + periodicGlottalSource voice voiced
aspirated + spreadGlottis spread
breathy + spreadGlottis spread
creaky + constrictedGlottis constr
nasalized + nasal
long + long LONG
dental + distributed
syllabic + syllabic SYLLABIC
non-syllabic - syllabic SYLLABIC
ejective + raisedLarynxEjective constrictedGlottis constr
glottalized + constrictedGlottis constr
palatalized + high
labialized + round
more-rounded + round
less-rounded - round
velarized + dorsal
pharyngealized + retractedTongueRoot
advanced-tongue-root + advancedTongueRoot ATR
retracted-tongue-root + retractedTongueRoot
"""
# column@node of the valued systems
VALUED_COLUMNS = {
    "phoible": "advancedTongueRoot@TongueRoot|anterior@Coronal|approximant@Manner|back@Dorsal|click@Manner|consonantal@Manner|constrictedGlottis@Laryngeal|continuant@Manner|coronal@Coronal|delayedRelease@Manner|distributed@Coronal|dorsal@Dorsal|epilaryngealSource@Laryngeal|fortis@Laryngeal|front@Dorsal|high@Dorsal|labial@Labial|labiodental@Labial|lateral@Manner|lenis@Laryngeal|long@Prosodic|low@Dorsal|loweredLarynxImplosive@Laryngeal|nasal@Manner|periodicGlottalSource@Laryngeal|raisedLarynxEjective@Laryngeal|retractedTongueRoot@TongueRoot|round@Labial|short@Prosodic|sonorant@Manner|spreadGlottis@Laryngeal|stress@Prosodic|strident@Coronal|syllabic@Manner|tap@Manner|tense@TongueRoot|tone@Tonal|trill@Manner",
    "pbase-hc": "ATR@TongueRoot|EXTRA@Prosodic|LONG@Prosodic|anterior@Coronal|back@Dorsal|consonantal@Manner|constr@Laryngeal|continuant@Manner|coronal@Coronal|distributed@Coronal|high@Dorsal|labial@Labial|lateral@Manner|low@Dorsal|nasal@Manner|round@Labial|sonorant@Manner|spread@Laryngeal|strident@Manner|syllabic@Manner|tense@TongueRoot|vocalic@Manner|voice@Laryngeal",
    "pbase-spe": "EXTRA@Prosodic|LONG@Prosodic|anterior@Coronal|back@Dorsal|consonantal@Manner|continuant@Manner|coronal@Coronal|covered@Laryngeal|delayed_primary_release@Manner|delayed_release_of_secondary_closure@Manner|distributed@Coronal|glottal_(tertiary)_closure@Laryngeal|heightened_subglottal_pressure@Laryngeal|high@Dorsal|lateral@Manner|low@Dorsal|movement_of_glottal_closure@Laryngeal|nasal@Manner|round@Labial|sonorant@Manner|strident@Manner|syllabic@Manner|tense@TongueRoot|vocalic@Manner|voice@Laryngeal",
    "pbase-jfh": "EXTRA@Prosodic|LONG@Prosodic|checked@Laryngeal|compact@Dorsal|consonantal@Manner|diffuse@Dorsal|flat@Labial|grave@Place|interrupted@Manner|nasal@Manner|sharp@Coronal|strident@Manner|tense@TongueRoot|vocalic@Manner|voiced@Laryngeal",
    "pbase-uftc": "ATR@TongueRoot|C-place@Place|EXTRA@Prosodic|LONG@Prosodic|SYLLABIC@Manner|V-place@Place|anterior (C)@Coronal|anterior (V)@Coronal|anterior (any)@Coronal|approximant@Manner|constricted@Laryngeal|continuant@Manner|coronal (C)@Coronal|coronal (V)@Coronal|coronal (any)@Coronal|distributed (C)@Coronal|distributed (V)@Coronal|distributed (any)@Coronal|dorsal (C)@Dorsal|dorsal (V)@Dorsal|dorsal (any)@Dorsal|labial (C)@Labial|labial (V)@Labial|labial (any)@Labial|lateral@Manner|lingual (C)@Coronal|lingual (V)@Coronal|lingual (any)@Coronal|nasal@Manner|open1@Dorsal|open2@Dorsal|open3@Dorsal|open4@Dorsal|open5@Dorsal|open6@Dorsal|pharyngeal (C)@Pharyngeal|pharyngeal (V)@Pharyngeal|pharyngeal (any)@Pharyngeal|sonorant@Manner|spread@Laryngeal|strident@Manner|vocalic@Manner|vocoid@Manner|voice@Laryngeal",
}
# spelling, words: two letters that are one segment
COMPLEX = """
kp consonant labio-velar stop voiceless
gb consonant labio-velar stop voiced
ŋm consonant labio-velar nasal voiced
kx consonant velar affricate voiceless
gɣ consonant velar affricate voiced
kɣ consonant velar affricate
ts consonant alveolar affricate voiceless sibilant
dz consonant alveolar affricate voiced sibilant
tʃ consonant post-alveolar affricate voiceless sibilant
dʒ consonant post-alveolar affricate voiced sibilant
tɕ consonant alveolo-palatal affricate voiceless sibilant
dʑ consonant alveolo-palatal affricate voiced sibilant
tʂ consonant retroflex affricate voiceless sibilant
dʐ consonant retroflex affricate voiced sibilant
mb consonant bilabial stop voiced pre-nasalized
nd consonant alveolar stop voiced pre-nasalized
ŋg consonant velar stop voiced pre-nasalized
ɲɟ consonant palatal stop voiced pre-nasalized
ɳɖ consonant retroflex stop voiced pre-nasalized
"""
# place, class labels
PLACE_CLASSES = """
alveolar anterior non-distributed
alveolo-palatal non-anterior distributed
dental anterior distributed
linguolabial anterior distributed
post-alveolar non-anterior distributed
retroflex non-anterior non-distributed
"""
# pairs of modifiers that can't hold at once
CONTRADICTIONS = """
syllabic non-syllabic
apical laminal
advanced retracted
raised lowered
more-rounded less-rounded
advanced-tongue-root retracted-tongue-root
"""
# spelling, what it stands for in sources
CONVENTIONS = """
ɡ g
ʣ dz
ʤ dʒ
ʥ dʑ
ʦ ts
ʧ tʃ
ʨ tɕ
\u00e7 c\u0327
\u2019 ʼ
' ʼ
: ː
ɫ lˠ
ǝ ə
ɚ ə˞
ɝ ɜ˞
ˁ ˤ
ε ɛ
"""
VOWEL_LETTERS = "aeiouyɛɔəɨʉɯɵœæɐɑʌɪʊɤøɘɜɞɒɶʏɿʅʮʯ"
BOUNDARIES = "+.|‖"
CHAO = {"⁰": 0, "¹": 1, "²": 2, "³": 3, "⁴": 4, "⁵": 5, "˩": 1, "˨": 2, "˧": 3, "˦": 4, "˥": 5}
METADATA = ("consonant", "vowel", "tonal-autosegment", "diphthong", "triphthong", "complex", "geminate", "consonant-cluster")
METADATA_PREFIXES = ("n1-", "n2-", "n3-", "move-")
# how a segment of several parts is scored, and a tone against a segment
NUCLEUS_SHARE, OFFGLIDE_SHARE, LENGTH_PENALTY, COMPONENT_SHARE, SEGMENT_SHARE, CROSS_TIER_COST = 0.7, 0.3, 0.15, 0.8, 0.2, 1.0
# labels that a derived class feature follows from
CLASSES = """
sonorant nasal lateral approximant trill tap vowel
obstruent stop fricative affricate click implosive
continuant fricative approximant trill vowel
non-continuant stop affricate nasal implosive click
anterior linguolabial dental alveolar
non-anterior post-alveolar retroflex alveolo-palatal
distributed dental post-alveolar alveolo-palatal linguolabial
non-distributed alveolar retroflex
labial bilabial labio-dental labial labio-palatal labio-velar
coronal linguolabial dental alveolar post-alveolar retroflex alveolo-palatal
dorsal palatal palatal-velar velar uvular labio-palatal labio-velar
guttural pharyngeal epiglottal glottal
"""
GLIDE_PLACES = ("palatal", "labio-palatal", "labio-velar", "velar")
NON_PULMONIC = ("click", "nasal-click", "implosive", "non-pulmonic")
# listed letter, marks it is also listed with: there the mark's meaning is already in the listed letter
MARKED = """
d̠ ʰ ʰː ʲ ʲː ʷ ʷː ː ̰ ⁿ
e̞ ː ˑ ˑ̟ ˤ ̃ ̃ː ̠ ̥ ̰ ̹ˑ
l̠ ʱ ʲ ˑ
o̞ ː ˑ ˤ ˤː ̃ ̃ː ̃ˑ ̙ ̜ ̜ː ̜ˑ ̟ ̥ ̰
t̠ ʰ ʰː ʲ ʲː ʷ ʷː ː
ð̞ ʲ
ø̞ ː ˑ ˤ ̃ ̃ː ̃ˑ ̜ ̜ː
ɞ̞ ː ̃ ̃ː ̆
ɤ̞ ː ̃ ̃ː ̆ ̟̃
ɪ̈ ː ̃ ̃ː
ɯ̽ ː ̃ ̃ː
ɵ̞ ː ̃ ̃ː ̆ ̰
ɹ̠ ʲ
ʁ̞ ʷ ̰ʷ
ʊ̈ ː ̃ ̃ː
β̞ ʲ ː ˠ
"""

# Further listed spellings, a line for each base; their labels follow from the grammar.
SPELLED = """
a̰ːː
d̪ d̪ɮ d̪ʰ d̪ʰː d̪ʰˠ d̪ʰˤ d̪ʱ d̪ʱː d̪ʱˠ d̪ʱˤ d̪ʲ d̪ʲʰ d̪ʲʱ d̪ʲʷ d̪ʲʷʰ d̪ʲː d̪ʷ d̪ʷʰ d̪ʷʰː d̪ʷʰˠ d̪ʷʰˤ d̪ʷʱ d̪ʷˀ d̪ʷː d̪ʷˠ d̪ʷˤ d̪ˀ d̪ː d̪ˠ d̪ˠː d̪ˡ d̪ˤ d̪ˤː d̪̃ d̪̃ː d̪̃ˤ d̪̚ d̪̟ d̪̠ d̪̥ d̪̥ʱ d̪̥̚ d̪̥ⁿ d̪̰ d̪̰ʲ d̪̰ʷ d̪̰ː d̪̰ˠ d̪̰ˤ d̪̰̃ d̪̺ d̪̻ d̪ᶣ d̪ᶣʰ d̪ⁿ d̼ ˀd̪ ⁿd̪ ⁿd̼
dz̪ dz̪ʰ dz̪ʰː dz̪ʰˠ dz̪ʰˤ dz̪ʱ dz̪ʱː dz̪ʱˠ dz̪ʱˤ dz̪ʲ dz̪ʲʰ dz̪ʲʱ dz̪ʲʷ dz̪ʲʷʰ dz̪ʲː dz̪ʷ dz̪ʷʰ dz̪ʷʰː dz̪ʷʰˠ dz̪ʷʰˤ dz̪ʷʱ dz̪ʷˀ dz̪ʷː dz̪ʷˠ dz̪ʷˤ dz̪ˀ dz̪ː dz̪ˠ dz̪ˠː dz̪ˤ dz̪ˤː dz̪̃ dz̪̃ː dz̪̃ˤ dz̪̟ dz̪̠ dz̪̰ dz̪̰ʲ dz̪̰ʷ dz̪̰ː dz̪̰ˠ dz̪̰ˤ dz̪̰̃ dz̪̺ dz̪̻ dz̪ᶣ dz̪ᶣʰ ˀdz̪
ⁿdʒ
eːː
ⁿgǃ
iːː ḭːː
l̪ l̪ʰ l̪ʱ l̪ʱː l̪ʱˠ l̪ʱˤ l̪ʲ l̪ʲʱ l̪ʲʷ l̪ʲː l̪ʷ l̪ʷʱ l̪ʷˀ l̪ʷː l̪ʷˠ l̪ʷˤ l̪ʼ l̪ˀ l̪ː l̪ˠ l̪ˠː l̪ˤ l̪ˤː l̪̃ l̪̃ː l̪̃ˤ l̪̝ l̪̞ l̪̟ l̪̠ l̪̥ l̪̥ʱ l̪̥ʲ l̪̥ʷ l̪̥ː l̪̥ˠ l̪̥ˤ l̪̩ l̪̰ l̪̰ʲ l̪̰ʷ l̪̰ː l̪̰ˠ l̪̰ˤ l̪̰̃ l̪̺ l̪̻ l̪ᶣ l̼ ˀl̪ ˀl̪̥
n̪ n̪ʰ n̪ʰː n̪ʱ n̪ʱː n̪ʱˠ n̪ʱˤ n̪ʲ n̪ʲʱ n̪ʲʷ n̪ʲː n̪ʷ n̪ʷʱ n̪ʷˀ n̪ʷː n̪ʷˠ n̪ʷˤ n̪ʼ n̪ˀ n̪ː n̪ˠ n̪ˠː n̪ˤ n̪ˤː n̪̟ n̪̠ n̪̥ n̪̥ʱ n̪̥ʲ n̪̥ʷ n̪̥ː n̪̥ˠ n̪̥ˤ n̪̩ n̪̰ n̪̰ʲ n̪̰ʷ n̪̰ː n̪̰ˠ n̪̰ˤ n̪̺ n̪̻ n̪ᶣ n̼ ˀn̪ ˀn̪̥
oːː
r̪ r̪ʱ r̪ʱː r̪ʱˠ r̪ʱˤ r̪ʲ r̪ʲʱ r̪ʲʷ r̪ʲː r̪ʷ r̪ʷʱ r̪ʷˀ r̪ʷː r̪ʷˠ r̪ʷˤ r̪ˀ r̪ː r̪ˠ r̪ˠː r̪ˤ r̪ˤː r̪̃ r̪̃ː r̪̃ˤ r̪̝ r̪̞ r̪̟ r̪̠ r̪̥ r̪̥ʱ r̪̥ʲ r̪̥ʷ r̪̥ː r̪̥ˠ r̪̥ˤ r̪̩ r̪̰ r̪̰ʲ r̪̰ʷ r̪̰ː r̪̰ˠ r̪̰ˤ r̪̰̃ r̪̺ r̪̻ r̪ᶣ r̼ ˀr̪
s̪ s̪ʰ s̪ʰː s̪ʰˠ s̪ʰˤ s̪ʲ s̪ʲʰ s̪ʲʷ s̪ʲʷʰ s̪ʲː s̪ʷ s̪ʷʰ s̪ʷʰː s̪ʷʰˠ s̪ʷʰˤ s̪ʷˀ s̪ʷː s̪ʷˠ s̪ʷˤ s̪ʼ s̪ʼʲ s̪ʼʷ s̪ʼʷˤ s̪ʼː s̪ʼˤ s̪ˀ s̪ˀː s̪ː s̪ˠ s̪ˠː s̪ˤ s̪ˤː s̪̝ s̪̞ s̪̟ s̪̠ s̪̩ s̪̺ s̪̻ s̪ᶣ s̪ᶣʰ ʰs̪ ˀs̪
t̪ t̪ʰ t̪ʰʲ t̪ʰː t̪ʰˠ t̪ʰˤ t̪ʲ t̪ʲʷ t̪ʲʷʰ t̪ʲː t̪ʷ t̪ʷʰ t̪ʷʰː t̪ʷʰˠ t̪ʷʰˤ t̪ʷˀ t̪ʷː t̪ʷˠ t̪ʷˤ t̪ʼ t̪ʼʲ t̪ʼʲʷ t̪ʼʷ t̪ʼʷˤ t̪ʼː t̪ʼˤ t̪ˀ t̪ː t̪ˠ t̪ˠː t̪ˡ t̪ˤ t̪ˤː t̪̚ t̪̟ t̪̠ t̪̰ t̪̺ t̪̻ t̪ᶣ t̪ᶣʰ t̪ⁿ t̼ ʰt̪ ʰt̪ʰ ˀt̪ ˀt̪ʰ ⁿt̪
ts̪ ts̪ʰ ts̪ʲ ts̪ʲʰ ts̪ʲʷ ts̪ʲʷʰ ts̪ʲː ts̪ʷ ts̪ʷʰ ts̪ʷʰː ts̪ʷʰˠ ts̪ʷʰˤ ts̪ʷˀ ts̪ʷː ts̪ʷˠ ts̪ʷˤ ts̪ʼ ts̪ʼʲ ts̪ʼʲʷ ts̪ʼʷ ts̪ʼʷˤ ts̪ʼː ts̪ʼˤ ts̪ˀ ts̪ː ts̪ˠ ts̪ˠː ts̪ˤ ts̪ˤː ts̪̟ ts̪̠ ts̪̺ ts̪̻ ts̪ᶣ ˀts̪
tɬ̪ tɬ̪ʰ tɬ̪ʰː tɬ̪ʰˠ tɬ̪ʰˤ tɬ̪ʲ tɬ̪ʲʰ tɬ̪ʲʷ tɬ̪ʲʷʰ tɬ̪ʲː tɬ̪ʷ tɬ̪ʷʰ tɬ̪ʷʰː tɬ̪ʷʰˠ tɬ̪ʷʰˤ tɬ̪ʷˀ tɬ̪ʷː tɬ̪ʷˠ tɬ̪ʷˤ tɬ̪ʼ tɬ̪ʼʲ tɬ̪ʼʷ tɬ̪ʼʷˤ tɬ̪ʼː tɬ̪ʼˤ tɬ̪ˀ tɬ̪ː tɬ̪ˠ tɬ̪ˠː tɬ̪ˤ tɬ̪ˤː tɬ̪̟ tɬ̪̠ tɬ̪̺ tɬ̪̻ tɬ̪ᶣ tɬ̪ᶣʰ ˀtɬ̪
uːː
yːː
z̪ z̪ʱ z̪ʱː z̪ʱˠ z̪ʱˤ z̪ʲ z̪ʲʱ z̪ʲʷ z̪ʲː z̪ʷ z̪ʷʱ z̪ʷˀ z̪ʷː z̪ʷˠ z̪ʷˤ z̪ˀ z̪ː z̪ˠ z̪ˠː z̪ˤ z̪ˤː z̪̃ z̪̃ː z̪̃ˤ z̪̝ z̪̞ z̪̟ z̪̠ z̪̥ z̪̩ z̪̰ z̪̰ʲ z̪̰ʷ z̪̰ː z̪̰ˠ z̪̰ˤ z̪̰̃ z̪̺ z̪̻ z̪ᶣ z̻ ˀz̪
æːː
ð̼
øːː
ɛːː
ɬ̪ ɬ̪ʰ ɬ̪ʰː ɬ̪ʰˠ ɬ̪ʰˤ ɬ̪ʲ ɬ̪ʲʰ ɬ̪ʲʷ ɬ̪ʲʷʰ ɬ̪ʲː ɬ̪ʷ ɬ̪ʷʰ ɬ̪ʷʰː ɬ̪ʷʰˠ ɬ̪ʷʰˤ ɬ̪ʷˀ ɬ̪ʷː ɬ̪ʷˠ ɬ̪ʷˤ ɬ̪ʼ ɬ̪ʼʲ ɬ̪ʼʷ ɬ̪ʼʷˤ ɬ̪ʼː ɬ̪ʼˤ ɬ̪ˀ ɬ̪ː ɬ̪ˠ ɬ̪ˠː ɬ̪ˤ ɬ̪ˤː ɬ̪̝ ɬ̪̞ ɬ̪̟ ɬ̪̠ ɬ̪̺ ɬ̪̻ ɬ̪ᶣ ɬ̪ᶣʰ ɬ̼ ˀɬ̪
ɮ̼
ɾ̼
ʈʂː
θ̼
"""
# spelling, a label of its base that its row doesn't have
SPELLED_WITHOUT = """
ts̪ʰ sibilant
ⁿdʒ sibilant
"""
