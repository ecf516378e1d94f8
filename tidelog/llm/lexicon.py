"""Weighted lexicon of abusive language: phrases, their weights, and phrases that excuse what they cover.

All are written plainly; they are folded as the texts are before they are matched. A weight of 1 makes a passage abusive by
itself, whoever is meant. Insults weigh less and need a cue that somebody is meant: as a name for a thing, for oneself or in a report
they have none, or an excuse covers them.
"""

from __future__ import annotations

from itertools import product

# Names people are called, by language (weight INSULT; they count together with a cue near by).
INSULTS = {
    "en": """idiot moron imbecile cretin halfwit half-wit loser bastard bitch prick scumbag asshole arsehole dumbass jackass dickhead
        shithead dimwit nitwit wanker tosser twat cunt whore slut retard faggot dipshit douchebag motherfucker cocksucker fuckwit
        bonehead numbskull simpleton dunce pig swine vermin parasite scum lowlife degenerate pervert creep clown fool
        idiotic moronic imbecilic""".split(),
    "de": """idiot trottel vollidiot wichser arschloch depp vollpfosten dummkopf schwachkopf hurensohn missgeburt drecksau schlampe
        hure fotze spast versager penner abschaum schwein mistkerl""".split(),
    "es": """idiota gilipollas cabrón imbécil estúpido estúpida pendejo cretino tonto tonta capullo subnormal puta zorra maricón
        mamón payaso hijoputa escoria inútil""".split(),
    "fr": """idiot abruti crétin connard connasse imbécile débile enfoiré salaud salope pute bouffon ordure merdeux minable taré
        demeuré enculé pourriture""".split(),
}
INSULT = 0.6
# Words that also stand for things and events: insults only if said to be what a person is.
DIRECT = """failure|disgrace|embarrassment|disappointment|coward|liar|fraud|joke|waste|nobody|brainless|braindead|feigling|nichts|schande|
    cobarde|fracaso|fracasado|fracasada|vergüenza|lâche|raté|ratée|honte|échec"""
# Subjects with a verb, and words that may stand between them and what somebody is said to be.
ADDRESSED = "you are|you're|you were|you r|u r|u are|ur|you will always be|you'll always be|du bist|du warst|ihr seid|eres|usted es|tu es|t'es|vous êtes".split("|")
SPOKEN_OF = "he is|he's|he was|she is|she's|she was|er ist|sie ist".split("|")
DEGREES = """a|an|the|such|just|only|nothing|but|really|truly|so|too|simply|still|all|always|one|complete|total|utter|absolute|real|big|huge|fucking|bloody|damn|goddamn|little|
    ein|eine|der|die|das|nur|doch|einfach|echt|wirklich|total|un|una|el|la|muy|tan|todo|toda|une|le|vraiment|trop|si|qu'un|qu'une"""
# Insults that alone in a sentence may be meant literally.
LITERAL = "pig swine parasite vermin clown creep prick schwein zorra payaso ordure pourriture ゴミ カス bimbo coon jap dyke fag redskin".split()
# With one of these before it in its sentence an insult is said of something there, or of the writer; a cue in the next sentence is none for it.
OWN = "is|are|was|were|be|been|i|i'm|my|me|myself|it's|that's|ist|sind|war|waren|ich|bin|mein|es|son|era|eran|soy|fui|yo|est|sont|était|étaient|je|j'ai|suis|c'est|mon|said|called|says|wrote|sagte|dijo|dit|the|this|that".split("|")
INSULTS_JA = "クズ 馬鹿 バカ 間抜け アホ 阿呆 ゴミ カス 低能 ブス".split()

# Signs that a person is addressed or spoken of (weight CUE; several count once).
CUES = {
    "en": """you|your|yours|yourself|u|ur|@op|op|shut up|learn to read|what a|such a|typical|thank you for nothing|get lost|piss off|
        only a|like him|like her|he is|she is|they are|that guy is|this guy is|go away|stop breathing|whoever|what kind of|people like""",
    "de": """du|dein|deine|dich|dir|ihr seid|euch|sie sind|halt die|halt's maul|fresse|verschwinde|fragt nur ein|was für ein|so ein|
        verpiss dich|hau ab|er ist ein|sie ist eine""",
    "es": """tú|eres|tu|te|cállate|lárgate|de mierda|solo un|sólo un|vete|usted es|es un|menudo|vaya|qué pedazo de|hijo de""",
    "fr": """tu|toi|ton|ta|t'es|vous|sale|ferme ta|ferme-la|dégage|il faut être|espèce de|casse-toi|fini pour|pauvre|bande de|quel""",
}
CUE = 0.5
CUES_JA = "お前 おまえ あなた 君は てめえ 貴様 黙れ 消えろ 死ね 失せろ こいつ".split()

# Passages that are abusive whoever is meant (weight STRONG), as combinations of what they are made of; "a|b c|d" are all of a c, a d, b c, b d,
# and a part that ends with a bar may be left out.
STRONG = 1.0
THREATS = [
    # Death and pain wished for or told to bring about.
    "drop dead", "kys", "kill|hang|shoot|drown|end|neck yourself", "go die|hang_yourself|play_in_traffic", "slit|cut your wrists",
    "jump off a|the|some bridge|roof|cliff|building", "jump in front of a|the train|bus|truck", "throw yourself off|under|in_front", "hope_you|hope_he|hope_she die|rot|suffer|choke",
    "rot|burn in hell|prison|jail|a_ditch|a_cell|your_grave|a_cage|the_gutter", "choke on_it|to_death", "drink bleach", "stop|quit breathing", "waste|wasting of|the|our|my air|oxygen|skin|space you",
    "waste of air|oxygen|skin|breath|flesh", "wasting the|our|my|precious| air|oxygen", "you|he|she should|deserve_to|deserves_to|ought_to die|be_shot|be_hanged|be_killed|be_beaten|be_put_down", "wish you were dead|never_born",
    "do us|everyone|everybody|the_world|me a favor|favour and die|leave|disappear|quit|vanish|jump", "you will regret being born", "you'll regret being born",
    # Violence announced.
    
    "find_out|found_out|i_know|we_know where you|he|she live|lives|sleep|work", "break|smash|crush your|his|her neck|legs|teeth|arms|bones|face|skull|jaw|nose|fingers|knees", "cut|slit your|his|her throat|throats",
    "beat|punch|kick you|him|her up|to_death|to_a_pulp|in_the_face|in_the_teeth|bloody", "put|have a bullet in|through your|his|her head|skull|brain", "dance|piss|spit on your|his|her grave",
    "burn|burn_down your|his|her house|home|family", "see|find_out what happens to you", "you_are|you're|you_will_be dead_meat|a_dead_man|a_dead_woman", "your days are numbered|counted", "pay with your life|blood", "coming for you", "you|you'll will|never never walk|breathe again", "knock|kick|punch your|his|her teeth out|in",
    # The same in other languages.
    "ich bring|bringe|stech|steche|mach|mache|knall|knalle dich um|ab|kalt|fertig", "ich schlag|schlage|brech|breche|hau|haue dich|dir tot|zusammen|die_fresse|die_zähne|die_knochen|den_schädel", "verrecke", "geh|stirb sterben|einfach",
    "geh|geh_doch sterben", "häng|bring dich auf|um", "ich weiß wo du wohnst|schläfst", "du gehörst|sollst|solltest erschossen|sterben|verrecken|vergast", "spring von der|einer brücke",
    "te|os voy a matar|romper|reventar|partir|cortar|rajar", "voy a matarte|romperte|reventarte|partirte|rajarte", "ojalá te|se mueras|muera|pudras|mates|maten|atropelle|atropellen", "muérete|mátate|púdrete|ahórcate", "mereces morir|la_muerte", "sé dónde vives|trabajas",
    "je vais te tuer|casser|péter|défoncer|buter|crever|briser|saigner", "va crever|mourir|te_pendre|te_suicider", "crève", "tue-toi", "tu mérites|vas de_mourir|crever|mourir", "je sais où tu habites|vis|travailles",
]
INSULTING = [
    "go fuck|screw yourself", "fuck|screw you|off|yourself", "suck my dick|cock|balls", "kiss|lick my ass|arse", "eat|eating shit", "up your ass|arse", "shut your|the|yer mouth|fuck_up|trap|face|hole|gob|pie_hole", "stfu",
    "go to hell you", "you can go to hell", "bite me you",
    # Comparisons that disparage.
    "more brains|sense|intelligence|manners|talent|iq|class|dignity than you|him|her", "smarter|cleverer|brighter|better_looking|more_useful than you_will_ever_be|you_could_ever_be|you'll_ever_be",
    "as thick|stupid|dumb|ugly|useless|worthless|dense|pathetic|disgusting|retarded as you|your|yours", "brain_dead|braindead|ugly|stupid|useless|worthless like you|your_mother|your_kind", "piece|sack|pile of shit|crap|garbage|trash|filth like you",
    # What somebody addressed is said to be.
    "your|his|her whole|entire| life|existence|career is a|one_big mistake|joke|waste|failure|disgrace|embarrassment", "your mother|mum|mom|father|sister|wife|parents|family should_be|must_be|is|are ashamed|a_whore|a_slut|a_bitch|a_dog|a_pig",
    "your mother|mum should|ought_to have aborted|swallowed|drowned|strangled you", "should have been aborted|swallowed|drowned at birth", "nobody|no_one|noone here|in_the_world|on_earth| wants|likes|needs|loves|misses|would_miss you",
    "everyone|everybody|the_whole_world hates|despises you", "the|this world|forum|place would be better|better_off without you", "you are a|the mistake|waste|disgrace to", "you_are|you're worthless|pathetic|subhuman|garbage|trash|scum|vermin|filth|dirt|nothing",
    "you are so|too|such stupid|dumb|pathetic|worthless|retarded|ugly", "are|were you stupid|retarded|braindead|brain_dead|mentally_ill|dropped_as_a|dropped_on_your", "you're|you_are the dumbest|stupidest|ugliest|worst_excuse|most_stupid|most_useless",
    "you pathetic|worthless|stupid|dumb|filthy|disgusting|useless|retarded|brainless|braindead|spineless|miserable|ugly|rotten|vile|fat|little_shit|sick_fuck", "you|your ugly face|mug|mouth|mother", "you smell|stink like|of|worse", "you piece_of|sack_of|waste_of shit|garbage|trash|crap|skin",
    "son of a bitch you", "you son of a bitch", "people|someone|somebody like you should_not|shouldn't|should_never|should_be|make_me|disgust_me", "you make|made me sick|puke|vomit|want_to_vomit|want_to_puke", "dropped|drop you on the|your head", "dropped as a baby", "crawl back_into|under your|the|whatever hole|rock|cave",
    "get|buy|grow a brain", "no brain cells", "halt|halt's die|deine|dein| fresse|maul|klappe|schnauze", "fick|leck dich|mich", "verpiss dich", "leck mich am arsch",
    "du bist so|zu| dumm|blöd|behindert|hässlich|dämlich|wertlos", "bist du so|zu| dumm|blöd|behindert|hässlich|dämlich", "zu dumm|blöd zum", "du dumme|dummer|dummes|blöde|blöder|blödes|wertloser|wertloses|hässliche|arsch|hund|sau|opfer|stück_scheiße|stück_dreck", "du bist ein|der nichts|letzte_dreck|haufen_dreck",
    "ihr seid alle|doch_alle hirnlos|idioten|trottel|dumm", "ihr hirnlosen|dummen", "hast du kein|denn_kein hirn", "vete|iros a_la_mierda|al_infierno", "que te|os jodan|follen|den", "jódete|jodeos", "hijo|hija|hijos de puta|perra",
    "eres|sois tonto|tonta|idiota|imbécil|basura|feo|fea|patético|patética|una_basura|una_mierda|un_mierda|un_asco|escoria", "cierra|cállate la|el boca|pico|hocico", "pedazo de mierda|basura|idiota|imbécil", "tu puta madre", "no tienes cerebro",
    "va te|vous_faire foutre|enculer", "nique|niquer ta|votre mère", "ta gueule", "ferme ta|la", "fils|fille de pute|chienne", "tu es|t'es trop|vraiment| con|conne|nul|nulle|moche|bête|stupide|débile", "pauvre|sale|espèce_de|gros|bande de con|conne|cons|merde", "tu pues", "t'as pas de cerveau",
    "tu es|t'es une|vraiment_une merde|ordure", "sac|tas à|de merde", "grosse vache|truie",
]
DEGRADING = [
    # Like beasts, dirt or illness, by nature bad, made to serve.
    "breed|multiply|reproduce like rats|rabbits|vermin|cockroaches|flies|animals", "subhuman|subhumans|sub-human|untermensch|untermenschen", "thieves|criminals|liars|murderers|killers|cheats|traitors|rapists|terrorists|parasites|slaves by blood|nature|birth|race",
    "traitor|traitors|traitress to his|her|their|your|our|the own|own|white| blood|race|kind|people|nation", "too primitive|inferior|savage|backward|uncivilised|uncivilized|subhuman to think|learn|read|vote|live|work|understand|govern",
    "should|must|ought_to|born_to|made_to|meant_to serve|obey us|whites|our_people|our_race|their_masters", "dirty|filthy|stinking|disgusting|primitive animals|beasts|apes|savages|rats|pigs", "not|aren't|isn't really|even|fully human|people|human_beings|humans",
    "are not|aren't people|human|humans|human_beings|like_us", "belong in|behind a|the| cages|cage|camps|camp|zoo|jungle|ghetto|gas_chamber|gas_chambers|ovens|gutter|bars", "inferior|master|superior race|races|people|blood|stock|breed", "pollute|poison|dilute|taint our|the blood|race|nation|gene_pool",
    # Cleansing.
    "throw|kick|drive|chase|hunt|round|ship|lock them_all|every_one_of_them|all_of_them|every_last_one_of_them|every_single_one_of_them out|away|off|down|up|back", "hang|gas|shoot|burn|drown|exterminate|slaughter|castrate|sterilise|sterilize|deport|lynch them_all|all_of_them|every_one_of_them|the_lot_of_them|every_last_one_of_them",
    "gas|lynch|exterminate them", "wipe|wiped|finish|finished|kill|killed them|them_all off|out", "send|ship them|you|these|those back to the jungle|desert|caves|trees", "send|ship them back to where_they_came_from|africa", "go back to your own|own_fucking|fucking|stinking country|jungle|cave|desert",
    "gehören|gehört alle|einfach| weggesperrt|vergast|erschossen|ausgerottet|aufgehängt|ins_lager|in_den_käfig", "raus mit_dem|diesem|den pack|gesindel|abschaum|dreck", "alle abschieben|vergasen|aufhängen", "hay que echar|matar|exterminar|expulsar|quemar|colgar|eliminar los|las",
    "hay que echarlos|matarlos|exterminarlos|expulsarlos|quemarlos|colgarlos|eliminarlos", "que los|las echen|maten|quemen|cuelguen a_todos|todos", "qu'on les chasse|expulse|tue|pende|brûle|extermine|renvoie", "il faut les chasser|exterminer|tuer|expulser|renvoyer|brûler|éliminer",
]
# Two things that are degrading together, with so many words at most between them: (first, then, words).
TOGETHER = [
    (["burn|burn_down|bomb|blow_up|torch|raze|set_fire_to"], ["with everybody|everyone|all_of_them|the_people|their_children|their_families|them in_it|inside|in_there|still_inside|in_them"], 8),
    (["the_only|a|the_best good", "the best"], ["is a dead one", "are dead ones", "is when dead"], 3),
    (["was|were|used_to_be clean|pure|safe|white before|until"], ["crawled|swarmed|slithered|poured|moved|flooded|came in|out|over"], 6),
    (["can|could smell|sniff the|them|those|these|a|any"], ["before you|i|we|one see|sees|saw|meet them|one|him|her"], 4),
]
SEXUAL = [
    "porn|porno|pornography|xxx|hentai|bukkake|rimjob|blowjob|handjob|gangbang|cumshot|creampie|deepthroat|threesome|milf|milfs", "porn|porno|xxx|sex|nude|adult|erotic videos|video|clips|clip|pics|movies|films|tapes|tape|chat", "sex|nude|naked cam|cams|show|shows|webcam",
    "cam show|shows", "camgirl|camgirls", "nude|naked|topless pics|photos|pictures|selfies|girls|women|wives|teens|babes|men|boys", "hot|horny|lonely|naughty|sexy|slutty wives|housewives|girls|teens|moms|milfs|babes|singles|women", "send|sending|sell|selling|show|want nudes|me_nudes|me_nude",
    "used|worn|dirty underwear|panties|knickers|thongs", "see|watch|imagine|want you|her|him|me naked|nude|undressed", "fantasies about you|her|him|me", "touch|lick|kiss|feel|grope|taste you|her|him|your_body|her_body all_over|down_there|between_the_legs|between_your_legs|between_her_legs",
    "tied|chained|handcuffed|cuffed|spread to|on the|my|your bed", "beg|begs|begged|begging for my_cock|his_cock|sex|it_hard", "what i|i'd would| do to your_body|that_body|her_body|those_lips|that_ass|those_legs|those_tits", "without any clothes|clothing", "with no clothes on", "horny",
    "want|wants|wanted|like|love|going|need to fuck", "fuck|fucks|fucked|fucking her|him|all_night|tonight|you_hard|me_hard|me_harder|me_all_night", "have|had|having|want|wants|wanted|love|need|has sex", "sex tonight|with_me|with_you|with_her|with_him|all_night|twice|again_and",
    "masturbate|masturbates|masturbated|masturbating|masturbation|orgasm|orgasms|orgasmed|ejaculate|ejaculated|ejaculation", "came|cum|cumming|cums inside|in|on|all_over her|him|her_face|her_mouth|my_face|my_mouth", "cum|cums|jizz|sperm on|in|over", "came with a loud|wild|soft|long moan|cry|orgasm|scream",
    "moaned|moaning|moans with|in pleasure|ecstasy|delight|lust", "she|he|they moaned", "pulled|took|ripped|tore|slid|peeled off|down|aside her|his|my|your|their bra|panties|knickers|blouse|dress|skirt|thong|trousers|jeans|pants|underwear|boxers|shirt|clothes",
    "unhooked|unzipped|undid|unbuttoned|opened|removed her|his|my|your bra|blouse|jeans|trousers|pants|dress|fly|panties|belt|shirt", "kissed|licked|sucked|caressed|squeezed|stroked|grabbed|fondled|rubbed|touched her|his|my|your breasts|breast|nipples|thighs|cock|dick|pussy|tits|crotch|ass|boobs",
    "hand|hands|finger|fingers|tongue under|inside|between|into her|my|your|his panties|bra|skirt|thighs|legs|pants|pussy|clothes", "under|in|inside her|my|your|his panties|knickers|bra", "her|his|my|your|naked|big|huge|bare|perfect tits|boobs|breasts|nipples|cock|pussy|dick|clit|penis|vagina",
    "wet|tight|hot|hard|huge|big|thick pussy|cock|dick|cunt", "sucks|suck|sucked|sucking|rides|rode|riding|took|takes|taking|licks|licked his|my|your|a cock|dick|him_off|me_off", "sucks|suck|sucking cock|dick", "a|his|my|your|hard cock in|inside|deep", "jerk|jerked|jerking|jack|jacked off", "fingered|fingering|fingers her|herself|me",
    "spread her|your legs|thighs", "sit on my face", "bend|bent over for me|him", "anal|oral|group|wild|rough|hardcore sex", "erotic massage|story|stories|chat", "escort girls|girl|service", "thrust|thrusts|thrusting into|inside her|him|me", "between her thighs", "make|made you|her|him cum|come_hard", "lick your|her|his legs|pussy|clit|balls",
    "nacktbilder|nacktfotos|nacktvideos|titten|muschi|gefickt|ficken|wichsen|bumsen", "ich bin so|ganz| geil", "bin so geil", "geil auf dich|sie|ihn", "will|möchte dich|mit_dir ficken|schlafen|vögeln", "fick|blas mich|mir", "sex mit_dir|mir|ihr|ihm", "sex haben", "schwanz lutschen", "lutsch meinen", "feuchte|nasse fotze|muschi|möse",
    "foto|fotos|vídeo|vídeos|videos desnuda|desnudo|sin_ropa|porno", "desnuda|desnudo para mí|mi", "estoy|muy|tan cachondo|cachonda", "quiero|queremos follar|follarte|chuparte|comerte", "follar|follando|chúpame|mámamela|polvazo", "echar un polvo", "tetas|polla|pollas", "coño mojado|húmedo", "sexo conmigo|oral|anal|contigo",
    "photo|photos|vidéo|vidéos|images nue|nu|nues|coquine|porno", "envie|besoin de baiser|sexe|te_baiser", "baiser toute|avec|ce la_nuit|toi|soir", "te baiser", "baise|suce moi|ma|mon", "ma|sa bite", "tes|ses seins", "ta|sa chatte", "coucher avec toi|moi|elle", "sexe avec moi|toi", "jouir en|dans toi", "éjaculer", "levrette",
]
STRONG_JA = """死ね|殺すぞ|殺してやる|くたばれ|ぶっ殺す|皆殺し|消え失せろ|死んでくれ|死んだほうがいい|死んだ方がいい|首を吊れ|自殺しろ|殺すから|ぶん殴る|住所を知って|生きる価値がない|生きてる価値がない|お前は馬鹿|お前はバカ|お前はクズ|生まれてこなければよかった|生まれてこなきゃよかった"""
HATE_JA = "害虫だ|追い出せ|劣等民族|寄生虫だ|下等民族"
SEXUAL_JA = "裸の写真|裸を見せ|セックス|やらせろ|おっぱい|ちんこ|まんこ|フェラ|オナニー|中出し|ヤりたい|エロ動画|全裸写真"
# Groups of people are degraded as these, with any of the copulas before.
COPULAS = "are|are all|are just|are nothing but|are only|sind|sind alle|sind nur|son|son todos|son solo|sont|sont tous|sont de la|sont des".split("|")
BEASTS = """vermin|rats|parasites|cockroaches|animals|pigs|dogs|apes|monkeys|savages|filth|scum|subhuman|a plague|a disease|
    ungeziefer|ratten|parasiten|abschaum|tiere|dreck|schweine|untermenschen|affen|basura|ratas|parásitos|animales|escoria|cucarachas|alimañas|
    una plaga|vermine|rats|parasites|animaux|cafards|ordures|sauvages|racaille"""
# People spoken of as one of a contemptible kind.
ONE_OF = "by one of the|by one of those|by one of these|by those|by these|one of those|one of these".split("|")
CONTEMPT = "useless|miserable|worthless|filthy|stupid|braindead|brain-dead|disgusting|retarded|idiotic|moronic|primitive|savage|pathetic|subhuman|lousy|rotten|dumb|dirty|lazy".split("|")
# Slurs for people by origin, faith, sex, love or disability; abusive whoever is meant (weight STRONG), reports excepted.
SLURS = {
    "en": """nigger nigga niggers niggas kike wetback raghead towelhead sandnigger darkie jigaboo porchmonkey beaner pikey wop dago chinaman gook
        zipperhead spic faggot shemale shitskin mudslime jewboy negress halfbreed gyppo polack""".split(),
    "de": "kanake kanaken neger judensau saujude kümmeltürke schwuchtel schlitzauge kameltreiber zigeunerpack negerin polacken".split(),
    "es": "sudaca panchito negrata moraco maricón marica bollera travelo mongólico judiazo machupichu".split(),
    "fr": "bougnoule bicot youpin youpine bamboula bougnoul pédé tarlouze gouine niakoué chinetoque mongolien".split(),
}
# Slurs that are also common words need a cue.
SLURS_AMBIGUOUS = "chink coon paki jap dyke fag tranny mongoloid libtard spastic redskin bimbo tapette golliwog".split()
SLURS_JA = "チョンコ シナ人 土人 ニガー オカマ野郎 キチガイ 非国民".split()

# Threats: a vow, then harm to a person's body within a few words.
VOWS = """i will|i'll|i am going to|i'm going to|im going to|i am gonna|i'm gonna|gonna|ima|we will|we'll|we are going to|we're going to|i want to|i would love to|i'd love to|
    let me|someone should|somebody should|someone ought to|somebody ought to|they should|i hope someone|i hope somebody|hope they|i wish someone would|i swear i will"""
HARMS = "break|smash|cut|cut off|slit|crush|rip|rip off|rip out|tear off|tear out|bash|bash in|kick|kick in|punch|snap|chop off|knock out|gouge out|shatter|pound|burn|slice|stomp on|wring".split("|")
BODY = "head face skull neck throat legs leg arms arm bones teeth jaw nose fingers hands knees kneecaps ribs eyes ears spine balls guts tongue brains brain".split()
HARM_PERSON = "kill|murder|stab|shoot|strangle|choke|hang|beat|beat up|slap|punch|hurt|drown|bury|lynch|burn|rape|torture|behead|execute|gut|skin".split("|")
WISHED = "hope you|hope he|hope she|hope your family|hope your children|hope your kids|hope your mother|wish you would|wish he would|wish she would|may you".split("|")
WISHES = "die|dies|die soon|die in|rot|rots|suffer|suffers|burn|burns|bleed|choke|chokes|drown|get cancer|gets cancer|get sick and die|get hit by|get run over|never wake up|never walk again|lose everything|lose your job|lose your house|lose your children|get fired".split("|")

# People called such a beast.
BEASTLY = "brainless|braindead|brain dead|retarded|stupid|dumb|fat|ugly|filthy|dirty|slimy|worthless|disgusting|absolute|utter|hirnloser|hirnlose|dumme|fette|grosse|sale".split("|")
BEAST = "ape|monkey|pig|rat|cow|dog|donkey|swine|worm|maggot|muppet|coward|affe|sau|ziege|truie|vache".split("|")

# Groups of people; degraded if something of SLIGHTS is said to be what they are, something of ILLS what they do or should
# suffer, something of RIDS what should be done to them, or a word of contempt stands before them.
GROUPS = {
    "en": """immigrants|migrants|refugees|foreigners|asylum seekers|jews|muslims|christians|hindus|sikhs|catholics|arabs|africans|blacks|black people|whites|white people|asians|
        mexicans|latinos|hispanics|chinese people|the chinese|gypsies|roma people|gays|gay people|homosexuals|lesbians|transsexuals|trans people|transgender people|queers|women|females|girls|men|
        disabled people|poor people|homeless people|the homeless|old people|fat people|americans|germans|turks|poles|russians|ukrainians|indians|pakistanis|afghans|syrians|
        somalis|albanians|romanians|nigerians|koreans|japanese people|italians|greeks|kurds|palestinians|israelis|iranians|indigenous people|aboriginals|
        these people|those people|their kind|your kind|these foreigners|those foreigners""",
    "de": """ausländer|flüchtlinge|migranten|asylanten|juden|muslime|moslems|türken|araber|afrikaner|schwarze|schwarzen|zigeuner|polen|russen|frauen|weiber|schwule|schwulen|lesben|homosexuelle|
        behinderte|behinderten|asiaten|chinesen|syrer|afghanen|rumänen|obdachlose|diese leute|solche leute""",
    "es": """inmigrantes|refugiados|extranjeros|judíos|musulmanes|moros|árabes|africanos|negros|gitanos|mujeres|gays|homosexuales|lesbianas|chinos|mexicanos|latinos|rumanos|discapacitados|indios|esa gente""",
    "fr": """immigrés|migrants|réfugiés|étrangers|juifs|musulmans|arabes|africains|noirs|les roms|gitans|tsiganes|femmes|gays|homosexuels|lesbiennes|asiatiques|chinois|handicapés|roumains|ces gens""",
    "ja": "外国人|移民|難民|朝鮮人|韓国人|中国人|黒人|白人|ユダヤ人|在日|障害者|同性愛者|イスラム教徒|ホームレス|女ども|女は",
}
SLIGHTS = """vermin|rats|parasites|cockroaches|animals|pigs|dogs|apes|monkeys|savages|filth|scum|subhuman|trash|garbage|thieves|criminals|terrorists|rapists|murderers|liars|whores|sluts|
    invaders|leeches|maggots|insects|lice|barbarians|degenerates|perverts|freaks|abominations|an abomination|inferior|stupid|dumb|lazy|dirty|filthy|disgusting|primitive|worthless|useless|retarded|
    uncivilised|uncivilized|ugly|greedy|untrustworthy|less intelligent|less human|not human|evil|a cancer|a plague|a disease|a burden|
    ein krebsgeschwür|ein krebs|un cáncer|una enfermedad|una plaga|un cancer|une maladie|une plaie|kriminell|kriminelle|verbrecher|diebe|dumm|faul|dreckig|minderwertig|terroristen|vergewaltiger|abschaum|dreck|ungeziefer|parasiten|ratten|tiere|affen|schmarotzer|untermenschen|
    ladrones|delincuentes|criminales|terroristas|violadores|vagos|sucios|inferiores|basura|escoria|ratas|parásitos|animales|tontas|estúpidas|estúpidos|asesinos|
    voleurs|criminels|terroristes|violeurs|menteurs|fainéants|inférieurs|ordures|vermine|parasites|rats|animaux|racaille|stupides|idiotes"""
ILLS = """steal anything|steal your|steal our|steal like|steal whatever|stink|ought to be shot|ought to be hanged|ought to be locked|ought to be deported|ought to be castrated|should be locked up|should be castrated|
    should not be allowed to have children|should not be allowed to have kids|should not be allowed to work|should know their place|cannot think logically|can't think logically|cannot drive|can't think|
    are sick in the head|are out to destroy|should never have been freed|were better off as slaves|klauen alles|klauen wie|stehlen alles|stinken|no sirven para|huelen mal|apestan|puent|volent tout|
    猿だ|頭が悪い|下等だ|バカばかり|should be shot|should be gassed|should be hanged|should be killed|should be exterminated|should be drowned|should be sterilised|should be sterilized|should be burned|should be deported like|
    should be put in camps|should be wiped out|should be put down|should be beaten|should be eradicated|should all die|should die|should not be allowed to breed|should not be allowed to vote|
    must be exterminated|must be wiped out|must die|must be killed|need to be exterminated|deserve to die|deserve no rights|deserve to be|do not deserve to live|don't deserve to live|
    belong in the kitchen|belong in cages|belong in a cage|belong in prison|belong in camps|belong in the gutter|belong behind bars|breed like|ruin everything|cannot be trusted|can't be trusted|
    are ruining our|are ruining this|are destroying our|are poisoning our|are infesting|are invading|are taking over our|steal everything|are stealing our|only want to steal|
    control the banks|control the media|control everything|control the world|run the banks|run the media|have no place in|should go back to|do not belong here|don't belong here|are not human|
    are not people|are not really people|are too stupid to|are too dumb to|are too emotional to|are only good for|are good for nothing|smell like|
    gehören vergast|gehören erschossen|gehören weggesperrt|gehören abgeschoben|gehören an den herd|gehören ins lager|sollen verrecken|sollen sterben|raus|nehmen uns die|
    deben morir|deberían morir|merecen morir|vienen a robar|a la cámara de gas|roban todo|nos roban|
    doivent mourir|méritent de mourir|contrôlent tout|contrôlent les médias|contrôlent les banques|dehors|viennent voler|nous volent|à la cuisine|
    国に帰れ|国へ帰れ|帰れ|出て行け|出ていけ|犯罪者だ|犯罪者ばかり|劣っている|劣等|寄生虫だ|ゴミだ|クズだ|殺せ|いなくなれ|消えろ|馬鹿だ|バカだ|泥棒だ|日本から出"""
RIDS = """kill|kill all|kill the|kill all the|gas|gas the|gas all|hang|hang the|hang all|shoot|shoot all|shoot the|drown|drown the|drown all|lynch|exterminate|exterminate the|exterminate all|
    death to|death to the|death to all|deport all|get rid of the|get rid of all|wipe out|wipe out the|wipe out all|kick out the|kick out all|throw out the|throw out all|down with the|tod den|tod allen|vergast die|
    muerte a los|muerte a las|fuera los|mort aux|à mort les|dehors les|i hate|i hate all|i hate the|we hate|ich hasse|odio a los|odio a las|je hais les|je déteste les"""
SCORN = [*CONTEMPT, *"fucking bloody goddamn damn vile scheiß scheiss drecks dreckige dumme faule putain putos putas malditos sucios".split()]
# Between a group and what it is said to be: words for to be, then at most so many of the others.
BE = "are|is|were|aren't anything but|sind|son|sont|was".split("|")
BETWEEN = """all|just|only|nothing|but|a|an|the|bunch|pack|gang|lot|race|nation|band|of|such|so|too|always|mostly|really|simply|basically|born|naturally|usually|and|lying|thieving|more|than|real|
    alle|nur|alles|ein|eine|haufen|doch|faule|dreckige|dumme|todos|todas|solo|unos|unas|una|un|muy|panda|de|tous|toutes|que|des|une|bande|trop|juste""".replace("\n", " ").split("|")
REPORTED = "called the other|calls him|calls me|calls her|call him|call me|call her|calling me|calling him|calling her|calling somebody|calling someone|called him a|called her a|called me a|called us|called them|called him|called her|called me|called someone a|called somebody a|the word|the slur|the term|the insult|the n-word".split("|")

# Rough or explicit words that fall short of abuse by themselves.
MILD = {"fuck": 0.4, "fucking": 0.4, "shit": 0.2, "bullshit": 0.2, "crap": 0.1, "damn": 0.1, "ugly": 0.1, "pathetic": 0.3, "worthless": 0.3, "naked": 0.2, "nude": 0.4, "cock": 0.4, "pussy": 0.6, "dick": 0.4}
MILD_SEXUAL = "naked nude cock pussy dick desnuda nackt geil cachondo cachonda".split()
MILD |= {"scheiße": 0.2, "mist": 0.1, "mierda": 0.3, "merde": 0.2, "desnuda": 0.4, "nackt": 0.3, "geil": 0.4, "cachondo": 0.6, "cachonda": 0.6, "wertloser": 0.5, "wertlose": 0.5}

# What one of these covers is no abuse: words about things, technical terms, about oneself, reports of what others said; written as STRONG is.
ONESELF = "i was|i am|i'm|i feel like|i felt like|makes me|made me|me|am i|was i|i must be|ich bin|ich war|ich|bin ich|soy|fui|je suis|j'étais|suis-je|yo soy|bin so ein".split("|")
WHAT = "what|what a|what an|quel|quelle|qué|que|was für ein|so ein".split("|")
I_AM = "i am|i was|je suis|j'étais|fui|soy|ich bin|bin ich|ich war".split("|")
ARTICLES = "a|an|such a|such an|the|un|une|ein|der|el".split("|")
THINGS = "bug|bugs|all bugs|problem|error|issue|api|library|framework|compiler|config|regex|script|job|task|test|race condition|machine|thing|language|week|day|night|method|query|merge|bit".split("|")
EXCUSES = [
    "idiot|fool|moron proof", "idiot-proof|idiotproof|foolproof", "idiots|dummies guide", "stupid|silly me", "i was|am stupid", "calling people|each other names", "called somebody|someone", "wrote|said that i was",
    "fuck|shit|damn|crap|idiot|moron|bitch|cunt|dick|cock in the docs|code|comments|list|filter|regex|source|dictionary|dataset|test", "the word|term|string|variable|function|regex|insult|name|file fuck|shit|idiot|moron|bitch|bastard|cunt|dick|cock|pussy|slut|whore",
    "naked|nude pointer|pointers|constructor|eye|type|types|return|domain|object|gun|repository|import|singles", "point of failure", "failure mode|modes|rate|domain|domains|case|handling|message", "on|test|disk|network|hardware|build|power failure", "failure to",
    "master slave", "sex|gender and age", "middlesex|scunthorpe|sussex|essex|cocktail|cocktails|shuttlecock|peacock|hancock|dickens", "spic and span", "chink in the", "maine coon", "shoot|drop you|him|her a|an", "burn you|me a", "beat you|me to it",
    "garbage collector|collection|in", "parent|child|zombie|orphan process|processes", "the|guinea|apache pig", "pig latin|hive", "parasite|parasitic capacitance|inductance", "clown car", "cock valve", "moby dick", "dick tracy", "strip the naked",
    "kill them all off|with", "throw them all away|out of the", "es inútil|tonto|idiota que", "método inútil", "c'est débile|nul|con que", "so ein mist",
]
EXCUSES_JA = "国に帰れる|国に帰れば|国に帰れな|国に帰れた|国に帰れず|国へ帰れる|国へ帰れば|国へ帰れな|国へ帰れた|国へ帰れず|帰れる|帰れば|帰れな|帰れた|帰れず|殺せる|自分が馬鹿|自分は馬鹿|私が馬鹿|私は馬鹿|僕が馬鹿|自分がバカ|ゴミ箱|ゴミデータ"


def _list(text: str) -> list[str]:
    return [p.strip() for p in text.replace("\n", " ").split("|") if p.strip()]


def _plural(word: str) -> list[str]:
    return [word, word + ("es" if word.endswith(("s", "ch", "sh", "x")) else "s")]


def _groups() -> list[str]:
    return [g for text in GROUPS.values() for g in _list(text)]


def combined(parts: list[str]) -> list[str]:
    """All phrases of combinations: of "a|b c|d" a c, a d, b c and b d; one that ends with a bar may be left out. Words of one
    alternative are joined by an underscore."""
    out: list[str] = []
    for text in parts:
        out += [" ".join(w for w in ws if w) for ws in product(*_parts(text))]
    return out


def _parts(text: str) -> list[list[str]]:
    return [[w.replace("_", " ") for w in p.split("|")] for p in text.split(" ")]


ABUSIVE, HATEFUL, SEXUALLY = "abusive", "hateful", "sexual"


def phrases() -> dict[str, tuple[str, float, str]]:
    """phrase -> (kind, weight, category); kind is strong, insult, cue, mild or, without weight, direct, vow, harm, group, slight, ill,
    rid or one of the two sides of TOGETHER."""
    out: dict[str, tuple[str, float, str]] = {}

    def put(kind: str, weight: float, category: str, words) -> None:
        out.update((p, (kind, weight, category)) for p in words)

    for w, weight in MILD.items():
        put("mild", weight, SEXUALLY if w in MILD_SEXUAL else ABUSIVE, [w])
    for words in CUES.values():
        put("cue", CUE, ABUSIVE, _list(words))
    for words in INSULTS.values():
        put("insult", INSULT, ABUSIVE, [f for w in words for f in _plural(w)])
    for category, parts in ((ABUSIVE, THREATS), (ABUSIVE, INSULTING), (HATEFUL, DEGRADING), (SEXUALLY, SEXUAL)):
        put("strong", STRONG, category, combined(parts))
    put("strong", STRONG, HATEFUL, [f"{c} {b}" for c, b in product(COPULAS, _list(BEASTS))])
    put("strong", STRONG, HATEFUL, [f"{o} {c}" for o, c in product(ONE_OF, CONTEMPT)])
    put("strong", STRONG, HATEFUL, [f"{c} {a} {b}" for c, a, b in product(COPULAS, CONTEMPT, _list(BEASTS))])
    put("strong", STRONG, ABUSIVE, [f"{w} {d}" for w, d in product(WISHED, WISHES)])
    put("direct", 0.0, ABUSIVE, [f for w in _list(DIRECT) for f in _plural(w)])
    put("insult", INSULT, ABUSIVE, [f for a, b in product(BEASTLY, BEAST) for f in _plural(f"{a} {b}")])
    put("strong", STRONG, HATEFUL, [f"{a} {g}" for a, g in product(SCORN, _groups())] + [f"sales {g}" for g in _list(GROUPS["fr"])])
    put("strong", STRONG, HATEFUL, [f for words in SLURS.values() for w in words for f in _plural(w)] + SLURS_JA)
    put("insult", INSULT, HATEFUL, [f for w in SLURS_AMBIGUOUS for f in _plural(w)])
    # These have no weight of their own; together they are strong, see abuse.py.
    pairs = {"vow": _list(VOWS), "group": _groups(), "ill": _list(ILLS), "rid": _list(RIDS), "slight": _list(SLIGHTS)}
    pairs["harm"] = [f"{v} {p} {b}" for v, p, b in product(HARMS, ("your", "his", "her", "their"), BODY)] + [f"{v} {p}" for v, p in product(HARM_PERSON, ("you", "him", "her"))]
    for n, (first, then, _) in enumerate(TOGETHER):
        pairs[f"first{n}"], pairs[f"then{n}"] = combined(first), combined(then)
    for kind, found in pairs.items():
        for p in found:
            out.setdefault(p, (kind, 0.0, ABUSIVE if kind in ("vow", "harm") else HATEFUL))
    put("insult", INSULT, ABUSIVE, INSULTS_JA)
    put("cue", CUE, ABUSIVE, CUES_JA)
    for category, text in ((ABUSIVE, STRONG_JA), (HATEFUL, HATE_JA), (SEXUALLY, SEXUAL_JA)):
        put("strong", STRONG, category, _list(text))
    return out


def excuses() -> list[str]:
    things = [f"{w} of {a}{t}" for w, a, t in product(("bastard", "bitch", "son of a bitch", "motherfucker", "swine", "pig"), ("", "a ", "an ", "all ", "the "), THINGS)]
    return [*combined(EXCUSES), *_list(EXCUSES_JA), *things]
