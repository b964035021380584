"""Fixed word and phrase lists of the text filters. Callers may pass their own."""

# English function words.
ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()

# Further stop words, beyond the list above.
FURTHER = (
    "might wentwere still per cent able across almost also among cannot could dear either else "
    "ever every get got however least let like likely may must neither often rather said say says "
    "since tis twas us wants would yet ve re rt retweet #fuckem #fuck fuck ya yall yay youre youve "
    "ass factbox com &lt th retweeting dick fuckin shit via fucking shocker wtf hey ooh rt&amp &amp "
    "#retweet goooooooooo hellooo gooo fucks fucka bitch wey sooo helloooooo lol smfh"
).split()

STOP_WORDS = ENGLISH + FURTHER

# A post holding one of these phrases is spam (case matters).
SPAM_PHRASES = [
    "Jordan Bahrain Morocco Syria Qatar Oman Iraq Egypt United States",
    "Some of you on my facebook are asking if it's me",
    "@kylieminogue please Kylie Follow Me, please",
    "follow me please",
    "please follow me",
]
