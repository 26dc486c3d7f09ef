"""Published example results, which the queries of this package and the tests are held against."""

from __future__ import annotations

# grapheme, its labels in both categorical systems
FEATURES = """
p bilabial|consonant|consonantal|labial|non-continuant|obstruent|stop|voiceless
b bilabial|consonant|consonantal|labial|non-continuant|obstruent|stop|voiced
t alveolar|anterior|consonant|consonantal|coronal|non-continuant|non-distributed|obstruent|stop|voiceless
d alveolar|anterior|consonant|consonantal|coronal|non-continuant|non-distributed|obstruent|stop|voiced
k consonant|consonantal|dorsal|non-continuant|obstruent|stop|velar|voiceless
g consonant|consonantal|dorsal|non-continuant|obstruent|stop|velar|voiced
q consonant|consonantal|dorsal|non-continuant|obstruent|stop|uvular|voiceless
ʔ consonant|consonantal|glottal|guttural|non-continuant|obstruent|stop|voiceless
f consonant|consonantal|continuant|fricative|labial|labio-dental|obstruent|voiceless
v consonant|consonantal|continuant|fricative|labial|labio-dental|obstruent|voiced
s alveolar|anterior|consonant|consonantal|continuant|coronal|fricative|non-distributed|obstruent|sibilant|voiceless
z alveolar|anterior|consonant|consonantal|continuant|coronal|fricative|non-distributed|obstruent|sibilant|voiced
ʃ consonant|consonantal|continuant|coronal|distributed|fricative|non-anterior|obstruent|post-alveolar|sibilant|voiceless
ʒ consonant|consonantal|continuant|coronal|distributed|fricative|non-anterior|obstruent|post-alveolar|sibilant|voiced
x consonant|consonantal|continuant|dorsal|fricative|obstruent|velar|voiceless
h consonant|consonantal|continuant|fricative|glottal|guttural|obstruent|voiceless
m bilabial|consonant|consonantal|labial|nasal|non-continuant|sonorant|voiced
n alveolar|anterior|consonant|consonantal|coronal|nasal|non-continuant|non-distributed|sonorant|voiced
ŋ consonant|consonantal|dorsal|nasal|non-continuant|sonorant|velar|voiced
ɲ consonant|consonantal|dorsal|nasal|non-continuant|palatal|sonorant|voiced
l alveolar|anterior|approximant|consonant|consonantal|continuant|coronal|lateral|non-distributed|sonorant|voiced
r alveolar|anterior|consonant|consonantal|continuant|coronal|non-distributed|sonorant|trill|voiced
ɾ alveolar|anterior|consonant|consonantal|coronal|non-distributed|sonorant|tap|voiced
ɹ alveolar|anterior|approximant|consonant|consonantal|continuant|coronal|non-distributed|sonorant|voiced
ɬ alveolar|anterior|consonant|consonantal|continuant|coronal|fricative|lateral|non-distributed|sonorant|voiceless
j approximant|consonant|continuant|dorsal|palatal|sonorant|vocoid|voiced
w approximant|consonant|continuant|dorsal|labial|labio-velar|sonorant|vocoid|voiced
a continuant|front|open|sonorant|unrounded|vocoid|vowel
e close-mid|continuant|front|sonorant|unrounded|vocoid|vowel
i close|continuant|front|sonorant|unrounded|vocoid|vowel
o back|close-mid|continuant|rounded|sonorant|vocoid|vowel
u back|close|continuant|rounded|sonorant|vocoid|vowel
ɛ continuant|front|open-mid|sonorant|unrounded|vocoid|vowel
ɔ back|continuant|open-mid|rounded|sonorant|vocoid|vowel
ə central|continuant|mid|sonorant|unrounded|vocoid|vowel
ɨ central|close|continuant|sonorant|unrounded|vocoid|vowel
ɑ back|continuant|open|sonorant|unrounded|vocoid|vowel
æ continuant|front|near-open|sonorant|unrounded|vocoid|vowel
ø close-mid|continuant|front|rounded|sonorant|vocoid|vowel
y close|continuant|front|rounded|sonorant|vocoid|vowel
ɯ back|close|continuant|sonorant|unrounded|vocoid|vowel
ɓ bilabial|consonant|consonantal|implosive|labial|non-continuant|non-pulmonic|obstruent|voiced
ɗ anterior|consonant|consonantal|coronal|dental|distributed|implosive|non-continuant|non-pulmonic|obstruent|voiced
ǃ alveolar|anterior|click|consonant|consonantal|coronal|dorsal-closure|non-continuant|non-distributed|non-pulmonic|obstruent|voiceless
ǀ anterior|click|consonant|consonantal|coronal|dental|distributed|dorsal-closure|non-continuant|non-pulmonic|obstruent|voiceless
t͡s affricate|alveolar|anterior|consonant|consonantal|coronal|non-continuant|non-distributed|obstruent|sibilant|voiceless
d͡ʒ affricate|consonant|consonantal|coronal|distributed|non-anterior|non-continuant|obstruent|post-alveolar|sibilant|voiced
t͡ʃ affricate|consonant|consonantal|coronal|distributed|non-anterior|non-continuant|obstruent|post-alveolar|sibilant|voiceless
pʰ aspirated|bilabial|consonant|consonantal|labial|non-continuant|obstruent|stop|voiceless
tː alveolar|anterior|consonant|consonantal|coronal|long|non-continuant|non-distributed|obstruent|stop|voiceless
ã continuant|front|nasalized|open|sonorant|unrounded|vocoid|vowel
kʷ consonant|consonantal|dorsal|labialized|non-continuant|obstruent|stop|velar|voiceless
tʲ alveolar|anterior|consonant|consonantal|coronal|non-continuant|non-distributed|obstruent|palatalized|stop|voiceless
á continuant|front|open|sonorant|tone-mid-4|tone-offset-4|tone-onset-4|tone-present|unrounded|vocoid|vowel
à continuant|front|open|sonorant|tone-mid-2|tone-offset-2|tone-onset-2|tone-present|unrounded|vocoid|vowel
â continuant|front|open|sonorant|tone-mid-3|tone-offset-2|tone-onset-4|tone-present|unrounded|vocoid|vowel
"""

# system, two graphemes, their distance
DISTANCES = """
descriptive p b 0.1250000000
descriptive p t 0.2377622378
descriptive p k 0.1951219512
descriptive p a 0.7727272727
descriptive t d 0.1027397260
descriptive t s 0.2795031056
descriptive t n 0.3726708075
descriptive k g 0.1190476190
descriptive k q 0.0476190476
descriptive k x 0.2380952381
descriptive s z 0.0931677019
descriptive s ʃ 0.1428571429
descriptive s f 0.3101265823
descriptive m n 0.2377622378
descriptive m ŋ 0.1951219512
descriptive n l 0.3409090909
descriptive a e 0.1503759398
descriptive a i 0.2255639098
descriptive a o 0.4060150376
descriptive a u 0.4812030075
descriptive i u 0.2556390977
descriptive i e 0.0751879699
descriptive e o 0.2556390977
descriptive ɛ e 0.0751879699
descriptive ɔ o 0.0751879699
descriptive ə a 0.2030075188
descriptive p f 0.3250000000
descriptive b v 0.3250000000
descriptive d z 0.2795031056
descriptive j i 0.3264462810
descriptive w u 0.3872180451
descriptive l r 0.1863354037
descriptive l ɾ 0.2982954545
descriptive p p 0.0000000000
descriptive a a 0.0000000000
distinctive p b 0.1428571429
distinctive p t 0.2656250000
distinctive p k 0.2222222222
distinctive p a 0.6698113208
distinctive t d 0.1145038168
distinctive t s 0.2795031056
distinctive t n 0.3595890411
distinctive k g 0.1351351351
distinctive k q 0.0540540541
distinctive k x 0.2380952381
distinctive s z 0.0931677019
distinctive s ʃ 0.1428571429
distinctive s f 0.3101265823
distinctive m n 0.2656250000
distinctive m ŋ 0.2222222222
distinctive n l 0.2329192547
distinctive a e 0.1694915254
distinctive a i 0.2542372881
distinctive a o 0.4576271186
distinctive a u 0.5423728814
distinctive i u 0.2881355932
distinctive i e 0.0847457627
distinctive e o 0.2881355932
distinctive ɛ e 0.0847457627
distinctive ɔ o 0.0847457627
distinctive ə a 0.2288135593
distinctive p f 0.3250000000
distinctive b v 0.3250000000
distinctive d z 0.2795031056
distinctive j i 0.5283018868
distinctive w u 0.5762711864
distinctive l r 0.1541095890
distinctive l ɾ 0.2329192547
distinctive p p 0.0000000000
distinctive a a 0.0000000000
"""

# system, grapheme, cells of a valued system (parted by |, as names hold spaces)
VALUED_FEATURES = """
phoible p advancedTongueRoot=0|anterior=0|approximant=-|back=0|click=-|consonantal=+|constrictedGlottis=-|continuant=-|coronal=-|delayedRelease=-|distributed=0|dorsal=-|epilaryngealSource=-|fortis=-|front=0|high=0|labial=+|labiodental=-|lateral=-|lenis=-|long=-|low=0|loweredLarynxImplosive=-|nasal=-|periodicGlottalSource=-|raisedLarynxEjective=-|retractedTongueRoot=0|round=-|short=-|sonorant=-|spreadGlottis=-|stress=-|strident=0|syllabic=-|tap=-|tense=0|tone=0|trill=-
phoible b advancedTongueRoot=0|anterior=0|approximant=-|back=0|click=-|consonantal=+|constrictedGlottis=-|continuant=-|coronal=-|delayedRelease=-|distributed=0|dorsal=-|epilaryngealSource=-|fortis=-|front=0|high=0|labial=+|labiodental=-|lateral=-|lenis=-|long=-|low=0|loweredLarynxImplosive=-|nasal=-|periodicGlottalSource=+|raisedLarynxEjective=-|retractedTongueRoot=0|round=-|short=-|sonorant=-|spreadGlottis=-|stress=-|strident=0|syllabic=-|tap=-|tense=0|tone=0|trill=-
phoible t advancedTongueRoot=0|anterior=+|approximant=-|back=0|click=-|consonantal=+|constrictedGlottis=-|continuant=-|coronal=+|delayedRelease=-|distributed=-|dorsal=-|epilaryngealSource=-|fortis=-|front=0|high=0|labial=-|labiodental=0|lateral=-|lenis=-|long=-|low=0|loweredLarynxImplosive=-|nasal=-|periodicGlottalSource=-|raisedLarynxEjective=-|retractedTongueRoot=0|round=0|short=-|sonorant=-|spreadGlottis=-|stress=-|strident=-|syllabic=-|tap=-|tense=0|tone=0|trill=-
phoible k advancedTongueRoot=0|anterior=0|approximant=-|back=-|click=-|consonantal=+|constrictedGlottis=-|continuant=-|coronal=-|delayedRelease=-|distributed=0|dorsal=+|epilaryngealSource=-|fortis=-|front=-|high=+|labial=-|labiodental=0|lateral=-|lenis=-|long=-|low=-|loweredLarynxImplosive=-|nasal=-|periodicGlottalSource=-|raisedLarynxEjective=-|retractedTongueRoot=0|round=0|short=-|sonorant=-|spreadGlottis=-|stress=-|strident=0|syllabic=-|tap=-|tense=0|tone=0|trill=-
phoible s advancedTongueRoot=0|anterior=+|approximant=-|back=0|click=-|consonantal=+|constrictedGlottis=-|continuant=+|coronal=+|delayedRelease=+|distributed=-|dorsal=-|epilaryngealSource=-|fortis=-|front=0|high=0|labial=-|labiodental=0|lateral=-|lenis=-|long=-|low=0|loweredLarynxImplosive=-|nasal=-|periodicGlottalSource=-|raisedLarynxEjective=-|retractedTongueRoot=0|round=0|short=-|sonorant=-|spreadGlottis=-|stress=-|strident=+|syllabic=-|tap=-|tense=0|tone=0|trill=-
phoible n advancedTongueRoot=0|anterior=+|approximant=-|back=0|click=-|consonantal=+|constrictedGlottis=-|continuant=-|coronal=+|delayedRelease=0|distributed=-|dorsal=-|epilaryngealSource=-|fortis=-|front=0|high=0|labial=-|labiodental=0|lateral=-|lenis=-|long=-|low=0|loweredLarynxImplosive=-|nasal=+|periodicGlottalSource=+|raisedLarynxEjective=-|retractedTongueRoot=0|round=0|short=-|sonorant=+|spreadGlottis=-|stress=-|strident=-|syllabic=-|tap=-|tense=0|tone=0|trill=-
phoible a advancedTongueRoot=-|anterior=0|approximant=+|back=-|click=0|consonantal=-|constrictedGlottis=-|continuant=+|coronal=-|delayedRelease=0|distributed=0|dorsal=+|epilaryngealSource=-|fortis=0|front=-|high=-|labial=-|labiodental=0|lateral=-|lenis=?|long=-|low=+|loweredLarynxImplosive=-|nasal=-|periodicGlottalSource=+|raisedLarynxEjective=-|retractedTongueRoot=-|round=0|short=-|sonorant=+|spreadGlottis=-|stress=-|strident=0|syllabic=+|tap=-|tense=0|tone=0|trill=-
phoible i advancedTongueRoot=-|anterior=0|approximant=+|back=-|click=0|consonantal=-|constrictedGlottis=-|continuant=+|coronal=-|delayedRelease=0|distributed=0|dorsal=+|epilaryngealSource=-|fortis=0|front=+|high=+|labial=-|labiodental=0|lateral=-|lenis=?|long=-|low=-|loweredLarynxImplosive=-|nasal=-|periodicGlottalSource=+|raisedLarynxEjective=-|retractedTongueRoot=-|round=0|short=-|sonorant=+|spreadGlottis=-|stress=-|strident=0|syllabic=+|tap=-|tense=+|tone=0|trill=-
phoible e advancedTongueRoot=-|anterior=0|approximant=+|back=-|click=0|consonantal=-|constrictedGlottis=-|continuant=+|coronal=-|delayedRelease=0|distributed=0|dorsal=+|epilaryngealSource=-|fortis=0|front=+|high=-|labial=-|labiodental=0|lateral=-|lenis=?|long=-|low=-|loweredLarynxImplosive=-|nasal=-|periodicGlottalSource=+|raisedLarynxEjective=-|retractedTongueRoot=-|round=0|short=-|sonorant=+|spreadGlottis=-|stress=-|strident=0|syllabic=+|tap=-|tense=+|tone=0|trill=-
pbase-hc p ATR=n|EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|constr=-|continuant=-|coronal=-|distributed=+|high=-|labial=+|lateral=n|low=-|nasal=-|round=-|sonorant=-|spread=-|strident=-|syllabic=-|tense=.|vocalic=-|voice=-
pbase-hc b ATR=n|EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|constr=-|continuant=-|coronal=-|distributed=+|high=-|labial=+|lateral=n|low=-|nasal=-|round=-|sonorant=-|spread=-|strident=-|syllabic=-|tense=.|vocalic=-|voice=+
pbase-hc t ATR=n|EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|constr=-|continuant=-|coronal=+|distributed=-|high=-|labial=-|lateral=-|low=-|nasal=-|round=-|sonorant=-|spread=-|strident=-|syllabic=-|tense=.|vocalic=-|voice=-
pbase-hc k ATR=n|EXTRA=-|LONG=-|anterior=-|back=+|consonantal=+|constr=-|continuant=-|coronal=-|distributed=.|high=+|labial=-|lateral=n|low=-|nasal=-|round=-|sonorant=-|spread=-|strident=-|syllabic=-|tense=.|vocalic=-|voice=-
pbase-hc s ATR=n|EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|constr=-|continuant=+|coronal=+|distributed=-|high=-|labial=-|lateral=-|low=-|nasal=-|round=-|sonorant=-|spread=-|strident=+|syllabic=-|tense=.|vocalic=-|voice=-
pbase-hc n ATR=n|EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|constr=-|continuant=-|coronal=+|distributed=-|high=-|labial=-|lateral=-|low=-|nasal=+|round=-|sonorant=+|spread=-|strident=-|syllabic=-|tense=-|vocalic=-|voice=+
pbase-hc a ATR=-|EXTRA=-|LONG=-|anterior=-|back=+|consonantal=-|constr=-|continuant=+|coronal=-|distributed=n|high=-|labial=-|lateral=n|low=+|nasal=-|round=-|sonorant=+|spread=-|strident=-|syllabic=+|tense=-|vocalic=+|voice=+
pbase-hc i ATR=+|EXTRA=-|LONG=-|anterior=-|back=-|consonantal=-|constr=-|continuant=+|coronal=-|distributed=n|high=+|labial=-|lateral=n|low=-|nasal=-|round=-|sonorant=+|spread=-|strident=-|syllabic=+|tense=+|vocalic=+|voice=+
pbase-hc e ATR=+|EXTRA=-|LONG=-|anterior=-|back=-|consonantal=-|constr=-|continuant=+|coronal=-|distributed=n|high=-|labial=-|lateral=n|low=-|nasal=-|round=-|sonorant=+|spread=-|strident=-|syllabic=+|tense=+|vocalic=+|voice=+
pbase-spe p EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|continuant=-|coronal=-|covered=n|delayed_primary_release=-|delayed_release_of_secondary_closure=n|distributed=+|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=-|lateral=n|low=-|movement_of_glottal_closure=n|nasal=-|round=-|sonorant=-|strident=-|syllabic=-|tense=.|vocalic=-|voice=-
pbase-spe b EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|continuant=-|coronal=-|covered=n|delayed_primary_release=-|delayed_release_of_secondary_closure=n|distributed=+|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=-|lateral=n|low=-|movement_of_glottal_closure=n|nasal=-|round=-|sonorant=-|strident=-|syllabic=-|tense=.|vocalic=-|voice=+
pbase-spe t EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|continuant=-|coronal=+|covered=n|delayed_primary_release=-|delayed_release_of_secondary_closure=n|distributed=-|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=-|lateral=-|low=-|movement_of_glottal_closure=n|nasal=-|round=-|sonorant=-|strident=-|syllabic=-|tense=.|vocalic=-|voice=-
pbase-spe k EXTRA=-|LONG=-|anterior=-|back=+|consonantal=+|continuant=-|coronal=-|covered=n|delayed_primary_release=-|delayed_release_of_secondary_closure=n|distributed=.|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=+|lateral=n|low=-|movement_of_glottal_closure=n|nasal=-|round=-|sonorant=-|strident=-|syllabic=-|tense=.|vocalic=-|voice=-
pbase-spe s EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|continuant=+|coronal=+|covered=n|delayed_primary_release=n|delayed_release_of_secondary_closure=n|distributed=-|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=-|lateral=-|low=-|movement_of_glottal_closure=n|nasal=-|round=-|sonorant=-|strident=+|syllabic=-|tense=.|vocalic=-|voice=-
pbase-spe n EXTRA=-|LONG=-|anterior=+|back=-|consonantal=+|continuant=-|coronal=+|covered=n|delayed_primary_release=-|delayed_release_of_secondary_closure=n|distributed=-|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=-|lateral=-|low=-|movement_of_glottal_closure=n|nasal=+|round=-|sonorant=+|strident=-|syllabic=-|tense=-|vocalic=-|voice=+
pbase-spe a EXTRA=-|LONG=-|anterior=-|back=+|consonantal=-|continuant=+|coronal=-|covered=-|delayed_primary_release=n|delayed_release_of_secondary_closure=n|distributed=n|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=-|lateral=n|low=+|movement_of_glottal_closure=n|nasal=-|round=-|sonorant=+|strident=-|syllabic=+|tense=-|vocalic=+|voice=+
pbase-spe i EXTRA=-|LONG=-|anterior=-|back=-|consonantal=-|continuant=+|coronal=-|covered=-|delayed_primary_release=n|delayed_release_of_secondary_closure=n|distributed=n|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=+|lateral=n|low=-|movement_of_glottal_closure=n|nasal=-|round=-|sonorant=+|strident=-|syllabic=+|tense=+|vocalic=+|voice=+
pbase-spe e EXTRA=-|LONG=-|anterior=-|back=-|consonantal=-|continuant=+|coronal=-|covered=-|delayed_primary_release=n|delayed_release_of_secondary_closure=n|distributed=n|glottal_(tertiary)_closure=-|heightened_subglottal_pressure=-|high=-|lateral=n|low=-|movement_of_glottal_closure=n|nasal=-|round=-|sonorant=+|strident=-|syllabic=+|tense=+|vocalic=+|voice=+
pbase-jfh p EXTRA=-|LONG=-|checked=-|compact=-|consonantal=+|diffuse=+|flat=-|grave=+|interrupted=+|nasal=-|sharp=-|strident=-|tense=.|vocalic=-|voiced=-
pbase-jfh b EXTRA=-|LONG=-|checked=-|compact=-|consonantal=+|diffuse=+|flat=-|grave=+|interrupted=+|nasal=-|sharp=-|strident=-|tense=.|vocalic=-|voiced=+
pbase-jfh t EXTRA=-|LONG=-|checked=-|compact=-|consonantal=+|diffuse=+|flat=-|grave=-|interrupted=+|nasal=-|sharp=-|strident=-|tense=.|vocalic=-|voiced=-
pbase-jfh k EXTRA=-|LONG=-|checked=-|compact=+|consonantal=+|diffuse=-|flat=-|grave=+|interrupted=+|nasal=-|sharp=-|strident=-|tense=.|vocalic=-|voiced=-
pbase-jfh s EXTRA=-|LONG=-|checked=-|compact=-|consonantal=+|diffuse=+|flat=-|grave=-|interrupted=-|nasal=-|sharp=-|strident=+|tense=.|vocalic=-|voiced=-
pbase-jfh n EXTRA=-|LONG=-|checked=-|compact=-|consonantal=+|diffuse=+|flat=-|grave=-|interrupted=+|nasal=+|sharp=-|strident=-|tense=.|vocalic=-|voiced=+
pbase-jfh a EXTRA=-|LONG=-|checked=-|compact=+|consonantal=-|diffuse=-|flat=-|grave=+|interrupted=-|nasal=-|sharp=-|strident=-|tense=-|vocalic=+|voiced=+
pbase-jfh i EXTRA=-|LONG=-|checked=-|compact=-|consonantal=-|diffuse=+|flat=-|grave=-|interrupted=-|nasal=-|sharp=-|strident=-|tense=+|vocalic=+|voiced=+
pbase-jfh e EXTRA=-|LONG=-|checked=-|compact=-|consonantal=-|diffuse=-|flat=-|grave=-|interrupted=-|nasal=-|sharp=-|strident=-|tense=+|vocalic=+|voiced=+
pbase-uftc p ATR=n|C-place=x|EXTRA=-|LONG=-|SYLLABIC=-|V-place=o|anterior (C)=n|anterior (V)=n|anterior (any)=n|approximant=-|constricted=-|continuant=-|coronal (C)=-|coronal (V)=o|coronal (any)=-|distributed (C)=n|distributed (V)=n|distributed (any)=n|dorsal (C)=-|dorsal (V)=o|dorsal (any)=-|labial (C)=+|labial (V)=o|labial (any)=+|lateral=-|lingual (C)=-|lingual (V)=o|lingual (any)=-|nasal=-|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=o|pharyngeal (any)=-|sonorant=-|spread=-|strident=-|vocalic=o|vocoid=-|voice=-
pbase-uftc b ATR=n|C-place=x|EXTRA=-|LONG=-|SYLLABIC=-|V-place=o|anterior (C)=n|anterior (V)=n|anterior (any)=n|approximant=-|constricted=-|continuant=-|coronal (C)=-|coronal (V)=o|coronal (any)=-|distributed (C)=n|distributed (V)=n|distributed (any)=n|dorsal (C)=-|dorsal (V)=o|dorsal (any)=-|labial (C)=+|labial (V)=o|labial (any)=+|lateral=-|lingual (C)=-|lingual (V)=o|lingual (any)=-|nasal=-|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=o|pharyngeal (any)=-|sonorant=-|spread=-|strident=-|vocalic=o|vocoid=-|voice=+
pbase-uftc t ATR=n|C-place=x|EXTRA=-|LONG=-|SYLLABIC=-|V-place=o|anterior (C)=+|anterior (V)=n|anterior (any)=+|approximant=-|constricted=-|continuant=-|coronal (C)=+|coronal (V)=o|coronal (any)=+|distributed (C)=-|distributed (V)=n|distributed (any)=-|dorsal (C)=-|dorsal (V)=o|dorsal (any)=-|labial (C)=-|labial (V)=o|labial (any)=-|lateral=-|lingual (C)=+|lingual (V)=o|lingual (any)=+|nasal=-|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=o|pharyngeal (any)=-|sonorant=-|spread=-|strident=-|vocalic=o|vocoid=-|voice=-
pbase-uftc k ATR=n|C-place=x|EXTRA=-|LONG=-|SYLLABIC=-|V-place=o|anterior (C)=n|anterior (V)=n|anterior (any)=n|approximant=-|constricted=-|continuant=-|coronal (C)=-|coronal (V)=o|coronal (any)=-|distributed (C)=n|distributed (V)=n|distributed (any)=n|dorsal (C)=+|dorsal (V)=o|dorsal (any)=+|labial (C)=-|labial (V)=o|labial (any)=-|lateral=-|lingual (C)=+|lingual (V)=o|lingual (any)=+|nasal=-|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=o|pharyngeal (any)=-|sonorant=-|spread=-|strident=-|vocalic=o|vocoid=-|voice=-
pbase-uftc s ATR=n|C-place=x|EXTRA=-|LONG=-|SYLLABIC=-|V-place=o|anterior (C)=+|anterior (V)=n|anterior (any)=+|approximant=-|constricted=-|continuant=+|coronal (C)=+|coronal (V)=o|coronal (any)=+|distributed (C)=-|distributed (V)=n|distributed (any)=-|dorsal (C)=-|dorsal (V)=o|dorsal (any)=-|labial (C)=-|labial (V)=o|labial (any)=-|lateral=-|lingual (C)=+|lingual (V)=o|lingual (any)=+|nasal=-|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=o|pharyngeal (any)=-|sonorant=-|spread=-|strident=+|vocalic=o|vocoid=-|voice=-
pbase-uftc n ATR=n|C-place=x|EXTRA=-|LONG=-|SYLLABIC=-|V-place=o|anterior (C)=+|anterior (V)=n|anterior (any)=+|approximant=-|constricted=-|continuant=-|coronal (C)=+|coronal (V)=o|coronal (any)=+|distributed (C)=-|distributed (V)=n|distributed (any)=-|dorsal (C)=-|dorsal (V)=o|dorsal (any)=-|labial (C)=-|labial (V)=o|labial (any)=-|lateral=-|lingual (C)=+|lingual (V)=o|lingual (any)=+|nasal=+|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=o|pharyngeal (any)=-|sonorant=+|spread=-|strident=-|vocalic=o|vocoid=-|voice=+
pbase-uftc a ATR=-|C-place=x|EXTRA=-|LONG=-|SYLLABIC=+|V-place=x|anterior (C)=n|anterior (V)=n|anterior (any)=n|approximant=+|constricted=-|continuant=+|coronal (C)=-|coronal (V)=-|coronal (any)=-|distributed (C)=n|distributed (V)=n|distributed (any)=n|dorsal (C)=-|dorsal (V)=-|dorsal (any)=-|labial (C)=-|labial (V)=-|labial (any)=-|lateral=-|lingual (C)=-|lingual (V)=-|lingual (any)=-|nasal=-|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=-|pharyngeal (any)=-|sonorant=+|spread=-|strident=-|vocalic=x|vocoid=+|voice=+
pbase-uftc i ATR=+|C-place=x|EXTRA=-|LONG=-|SYLLABIC=+|V-place=x|anterior (C)=n|anterior (V)=-|anterior (any)=-|approximant=+|constricted=-|continuant=+|coronal (C)=-|coronal (V)=+|coronal (any)=+|distributed (C)=n|distributed (V)=+|distributed (any)=+|dorsal (C)=-|dorsal (V)=-|dorsal (any)=-|labial (C)=-|labial (V)=-|labial (any)=-|lateral=-|lingual (C)=-|lingual (V)=+|lingual (any)=+|nasal=-|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=-|pharyngeal (any)=-|sonorant=+|spread=-|strident=-|vocalic=x|vocoid=+|voice=+
pbase-uftc e ATR=+|C-place=x|EXTRA=-|LONG=-|SYLLABIC=+|V-place=x|anterior (C)=n|anterior (V)=-|anterior (any)=-|approximant=+|constricted=-|continuant=+|coronal (C)=-|coronal (V)=+|coronal (any)=+|distributed (C)=n|distributed (V)=+|distributed (any)=+|dorsal (C)=-|dorsal (V)=-|dorsal (any)=-|labial (C)=-|labial (V)=-|labial (any)=-|lateral=-|lingual (C)=-|lingual (V)=+|lingual (any)=+|nasal=-|open1=.|open2=.|open3=.|open4=.|open5=.|open6=.|pharyngeal (C)=-|pharyngeal (V)=-|pharyngeal (any)=-|sonorant=+|spread=-|strident=-|vocalic=x|vocoid=+|voice=+
"""

# valued system, two graphemes, their distance
VALUED_DISTANCES = """
phoible p b 0.0394736842
phoible p t 0.0555555556
phoible p k 0.0555555556
phoible p a 0.3666666667
phoible t s 0.1025641026
phoible t n 0.1200000000
phoible a e 0.0540540541
phoible a i 0.0810810811
phoible i e 0.0259740260
phoible p p 0.0000000000
phoible a a 0.0000000000
pbase-hc p b 0.0576923077
pbase-hc p t 0.1363636364
pbase-hc p k 0.1600000000
pbase-hc p a 0.5181818182
pbase-hc t s 0.1090909091
pbase-hc t n 0.1636363636
pbase-hc a e 0.1785714286
pbase-hc a i 0.2142857143
pbase-hc i e 0.0357142857
pbase-hc p p 0.0000000000
pbase-hc a a 0.0000000000
pbase-spe p b 0.0566037736
pbase-spe p t 0.0982142857
pbase-spe p k 0.1176470588
pbase-spe p a 0.5000000000
pbase-spe t s 0.1339285714
pbase-spe t n 0.1607142857
pbase-spe a e 0.1296296296
pbase-spe a i 0.1666666667
pbase-spe i e 0.0370370370
pbase-spe p p 0.0000000000
pbase-spe a a 0.0000000000
pbase-jfh p b 0.0789473684
pbase-jfh p t 0.0789473684
pbase-jfh p k 0.1052631579
pbase-jfh p a 0.4210526316
pbase-jfh t s 0.1578947368
pbase-jfh t n 0.1578947368
pbase-jfh a e 0.1951219512
pbase-jfh a i 0.2439024390
pbase-jfh i e 0.0487804878
pbase-jfh p p 0.0000000000
pbase-jfh a a 0.0000000000
pbase-uftc p b 0.0508474576
pbase-uftc p t 0.2388059701
pbase-uftc p k 0.2033898305
pbase-uftc p a 0.3958333333
pbase-uftc t s 0.0895522388
pbase-uftc t n 0.1343283582
pbase-uftc a e 0.1875000000
pbase-uftc a i 0.1875000000
pbase-uftc i e 0.0000000000
pbase-uftc p p 0.0000000000
pbase-uftc a a 0.0000000000
"""

# name of a set of labels, the labels
SETS = """
p consonant|voiceless|bilabial|stop
p-feats consonant|voiceless|bilabial|stop
b consonant|voiced|bilabial|stop
b-feats consonant|voiced|bilabial|stop
t-feats consonant|voiceless|alveolar|stop
k-feats consonant|voiceless|velar|stop
s-feats consonant|voiceless|alveolar|fricative
a vowel|open|front|unrounded
a-feats vowel|open|front|unrounded
i-feats vowel|close|front|unrounded
u-feats vowel|close|back|rounded
"""

# preset, two sets, their distance
PRESET_DISTANCES = """
None p b 0.2777777778
None p a 0.5000000000
ignore-tone p b 0.2777777778
ignore-tone p a 0.5000000000
segmental p b 0.3846153846
segmental p a 0.6875000000
flat p b 0.2500000000
flat p a 0.5000000000
"""

# two sets, their distance
SET_DISTANCES = """
p-feats b-feats 0.2777777778
p-feats t-feats 0.0000000000
p-feats k-feats 0.0000000000
p-feats s-feats 0.3333333333
p-feats a-feats 0.5000000000
p-feats i-feats 0.5000000000
p-feats u-feats 0.5000000000
b-feats t-feats 0.3333333333
b-feats k-feats 0.3333333333
b-feats s-feats 0.6666666667
b-feats a-feats 0.5000000000
b-feats i-feats 0.5000000000
b-feats u-feats 0.5000000000
t-feats k-feats 0.0000000000
t-feats s-feats 0.2500000000
t-feats a-feats 0.5000000000
t-feats i-feats 0.5000000000
t-feats u-feats 0.5000000000
k-feats s-feats 0.3333333333
k-feats a-feats 0.5000000000
k-feats i-feats 0.5000000000
k-feats u-feats 0.5000000000
s-feats a-feats 0.5000000000
s-feats i-feats 0.5000000000
s-feats u-feats 0.5000000000
a-feats i-feats 0.3797468354
a-feats u-feats 0.8101265823
i-feats u-feats 0.4303797468
"""

# two labels, hops between them
HOPS = """
voiced voiceless 2
voiced voiced 0
nasal lateral 4
aspirated voiceless 4
advanced retracted 2
advanced lowered 4
advanced coronal 5
advanced consonantal 6
voiced aspirated 4
sonorant continuant 4
breathy creaky 4
advanced palatalized 8
"""

# token, status, characters of the longest prefix that resolves, the character after it (-: none)
DIAGNOSES = """
pʰ ok 2 -
pʰ̳zz unknown-grapheme 2 ̳
¹²³⁴ parse-error 3 ⁴
<?> source-marker 0 <
"""

# token, its tone's onset, middle and offset
TONES = """
a⁵ 5 5 5
a˥ 5 5 5
a⁵¹ 5 3 1
a˥˩ 5 3 1
a⁵³¹ 5 3 1
"""

# first token, second token, whether their distance is below that of the third and fourth
CLUSTERS = """
ai au ai a
aa aː aa a
"""


def rows(text: str, width: int) -> list[list[str]]:
    """Lines as `width` fields; the last one may hold spaces."""
    return [line.split(" ", width - 1) for line in text.strip().split("\n")]
