"""Stop words of the text index by language."""

# The words that are not indexed, per language.
ENGLISH = """
    a about above after again against all am an and any are aren't as at be because been before being below between both
    but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had
    hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd
    i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
    only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such
    than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this
    those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's
    where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your
    yours yourself yourselves
"""
SPANISH = """
    el la los las un una unos unas y o pero si de del a al en con por para como es esta fue son sus mi tu su nos me te se lo
    le que este esta aquel ella ellos ellas nosotros vosotros mi mis tus sus muy tambien como donde
"""
FRENCH = """
    le la les un une des et ou mais si de du des à au aux en avec par pour comme est sont était été mon ton son mes tes ses
    nous vous il elle ils elles se y en que qui ce cette dans sur pas plus très mais donc ou
"""
GERMAN = """
    der die das ein eine einer eines einem einen und oder aber wenn von vom zu zum zur in im mit für wie ist sind war gewesen
    mein dein sein ihr wir ihr sie es er sich dass was wer wie aus bei nach um am an als auch so
"""
ITALIAN = """
    il la i gli le un uno una e o ma se di da in con su per tra fra come è sono era stato mio tuo suo nostro vostro loro mi
    ti si ci vi lo gli che chi questo quello anche più non perché ed ad
"""
PORTUGUESE = """
    o a os as um uma uns umas e ou mas se de do da dos das em no na nos nas com por para como é são era foi meu teu seu nosso
    vosso me te se lhe o a que quem este esta aquele também mais não porque com sem
"""

STOP_WORDS = {
    "en": frozenset(ENGLISH.split()),
    "es": frozenset(SPANISH.split()),
    "fr": frozenset(FRENCH.split()),
    "de": frozenset(GERMAN.split()),
    "it": frozenset(ITALIAN.split()),
    "pt": frozenset(PORTUGUESE.split()),
}
