"""Word lists of the Russian defaults. Every operator takes its lists as arguments."""

# Results depend on these lists.

STOP_WORDS = """а без более бы был была были было быть в вам вас весь во вот все всего всех вы где да даже для до его ее если есть еще же
за здесь и из или им их к как ко когда кто ли либо мне может мы на надо наш не него нее нет ни них но ну о об одной он она они оно от
очень по под при с со так также такой там те тем то того тоже той только том ты у уже хотя чего чем что чтобы чье эта эти это я""".split()

COMPLEX_SUFFIXES = "ность ость ение ание ция сть тель ист изм ическ альн ивн енн онн ированн".split()

CONNECTIVES = ["однако", "поэтому", "таким образом", "кроме того", "во-первых", "во-вторых"]

ABSTRACT = "концепция теория принцип подход метод система процесс анализ синтез структура функция отношение взаимодействие".split()

CONJUNCTIONS = ["что", "чтобы", "как", "когда", "если", "хотя", "поскольку", "потому", "так как", "несмотря", "благодаря"]

COMPOSITION = {
    "введение": ["введение", "предисловие", "пролог", "начало", "во-первых", "прежде всего"],
    "развитие": ["далее", "затем", "потом", "после этого", "во-вторых", "в-третьих", "кроме того"],
    "кульминация": ["наконец", "в конце концов", "главное", "самое важное", "кульминация"],
    "заключение": ["заключение", "в заключение", "итак", "таким образом", "в итоге", "напоследок"],
}

LINKS = {
    "причина": ["потому что", "поскольку", "так как", "из-за", "вследствие", "благодаря"],
    "следствие": ["поэтому", "следовательно", "в результате", "таким образом", "отсюда"],
    "противопоставление": ["но", "однако", "а", "зато", "тем не менее", "напротив", "все же"],
    "дополнение": ["также", "кроме того", "более того", "к тому же", "помимо этого"],
    "сравнение": ["как", "подобно", "словно", "будто", "по сравнению с", "аналогично"],
    "уступка": ["хотя", "несмотря на", "пусть", "даже если", "правда"],
}

EMOTIONS = {
    "радость": "радость счастье веселье восторг ликование блаженство эйфория смех улыбка хохот смеяться улыбаться радоваться веселиться счастливый весёлый радостный довольный восторженный ликующий прекрасно замечательно отлично великолепно чудесно превосходно".split(),
    "грусть": [*"грусть печаль тоска меланхолия скорбь горе уныние плач слёзы рыдание плакать рыдать грустить печалиться грустный печальный унылый скорбный тоскливый меланхоличный плохо ужасно печально жаль".split(), "к сожалению", "увы"],
    "гнев": "гнев злость ярость бешенство негодование возмущение раздражение крик ругань ссора кричать ругаться злиться бесится злой сердитый яростный разъярённый возмущённый раздражённый ненавижу проклятье чёрт дьявол бесит раздражает".split(),
    "страх": "страх ужас испуг тревога паника боязнь фобия дрожь крик вопль бояться пугаться дрожать трястись страшный ужасный пугающий тревожный жуткий кошмарный боже помогите спасите ужас кошмар беда".split(),
    "удивление": [*"удивление изумление поражение шок остолбенение ошеломление ох ах ого вау удивляться поражаться изумляться удивительный поразительный изумительный шокирующий невероятный неужели невозможно".split(), "не может быть", "вот это да", "надо же"],
    "отвращение": [*"отвращение омерзение брезгливость тошнота мерзость фу гадость мерзко противно тошнит воротит противный мерзкий гадкий отвратительный омерзительный".split(), "не выношу", "терпеть не могу", "до тошноты"],
    "презрение": "презрение пренебрежение высокомерие надменность снобизм фыркать морщиться презирать пренебрегать игнорировать презрительный пренебрежительный высокомерный надменный снобистский ничтожество мелочь плевать наплевать".split(),
}

CHARACTER = """сказал сказала подумал подумала ответил ответила спросил спросила произнёс произнесла крикнул крикнула прошептал прошептала
пробормотал пробормотала воскликнул воскликнула заметил заметила добавил добавила продолжил продолжила уточнил уточнила подтвердил
подтвердила возразил возразила согласился согласилась признался призналась объяснил объяснила рассказал рассказала поделился поделилась
намекнул намекнула предложил предложила посоветовал посоветовала предупредил предупредила пожаловался пожаловалась усмехнулся усмехнулась
засмеялся засмеялась вздохнул вздохнула промолвил промолвила буркнул буркнула он она его её ему ей им ней них они мужчина женщина парень
девушка старик старуха человек персонаж герой героиня друг подруга said asked replied thought whispered shouted murmured explained continued
added noted confirmed suggested warned complained laughed smiled sighed mumbled he she his her him them they man woman person character hero
friend""".split()

TENSION = """опасность угроза страх тревога паника ужас кошмар враг противник смерть кровь крик вопль стон бежать спасаться убегать скрываться
прятаться конфликт битва борьба драка столкновение преследование нападение атака удар выстрел взрыв катастрофа беда несчастье трагедия горе
печаль отчаяние злость гнев ярость бешенство ненависть месть предательство обман ложь измена коварство тайна секрет загадка мистерия
неизвестность болезнь боль страдание мучение агония пытка тьма мрак темнота пустота бездна пропасть молния гром буря ураган землетрясение
пожар война оружие меч нож пистолет автомат тюрьма клетка цепи кандалы плен заложник danger threat fear panic horror nightmare terror enemy
death blood scream cry pain suffering run escape flee hide conflict battle fight attack strike shot explosion disaster tragedy anger rage fury
hatred revenge betrayal secret mystery unknown darkness shadow abyss storm thunder lightning earthquake fire war weapon sword knife gun prison
chains""".split()

EVENTS = [
    *"""пошёл пошла побежал побежала прыгнул прыгнула ударил ударила схватил схватила открыл открыла бросил бросила нашёл нашла поймал поймала
выстрелил выстрелила взорвал взорвала сломал сломала разбил разбила построил построила создал создала вошёл вошла вышел вышла приехал
приехала уехал уехала прилетел прилетела улетел улетела появился появилась исчез исчезла проснулся проснулась заснул заснула встал встала
сел села лёг легла повернул повернула остановил остановила начал начала закончил закончила решил решила выбрал выбрала взял взяла дал дала
получил получила потерял потеряла купил купила продал продала украл украла спас спасла убил убила ранил ранила вылечил вылечила помог
помогла встретил встретила познакомился познакомилась поцеловал поцеловала женился""".split(),
    "вышла замуж",
    *"""развёлся развелась родил родила went ran jumped hit grabbed opened threw found caught shot exploded broke built created entered left
arrived departed appeared disappeared woke slept stood sat turned stopped started finished decided chose took gave received lost bought sold
stole saved killed wounded healed helped met kissed married divorced born""".split(),
]

SLOW = "медленно тихо спокойно постепенно неторопливо размеренно плавно осторожно аккуратно внимательно задумчиво мечтательно созерцательно философски slowly quietly calmly gradually carefully thoughtfully peacefully gently".split()
FAST = "быстро стремительно резко внезапно мгновенно молниеносно немедленно тотчас сразу моментально поспешно торопливо спешно срочно экстренно quickly rapidly suddenly immediately instantly swiftly hastily urgently abruptly".split()

WATER = {
    "слова_паразиты": ["как бы", "типа", "короче", "вообще", "в общем", "так сказать", "можно сказать", "если честно", "честно говоря", "прямо скажем", "надо сказать", "скажем так", "в принципе", "в основном", "по большому счету", "если можно так выразиться", "собственно говоря", "если разобраться", "как говорится", "между прочим", "в некотором смысле", "в каком-то смысле", "до определенной степени"],
    "канцеляризмы": ["в настоящее время", "на сегодняшний день", "в данный момент времени", "по состоянию на", "в течение длительного времени", "в ходе проведения", "с целью осуществления", "для обеспечения возможности", "в процессе реализации", "при условии соблюдения", "в рамках выполнения", "согласно установленным требованиям"],
    "избыточные_конструкции": ["дело в том что", "суть дела заключается в том", "хочется отметить что", "следует подчеркнуть что", "важно понимать что", "нельзя не сказать что", "стоит обратить внимание на то что", "необходимо отметить что", "хотелось бы подчеркнуть что", "не могу не отметить что"],
    "тавтологии": ["главная суть", "свободная вакансия", "прейскурант цен", "памятный сувенир", "совместное сотрудничество", "взаимное сотрудничество", "первая премьера", "старый ветеран", "молодой юноша", "народная демократия", "бесплатный подарок", "окружающая среда вокруг", "период времени", "огромная махина"],
    "штампы_клише": ["само собой разумеется", "без всякого сомнения", "как известно", "не секрет что", "всем известно что", "играет важную роль", "имеет большое значение", "нетрудно догадаться", "легко понять", "очевидно что", "понятно что", "ясно что"],
}

REPEATS = {
    "повтор_идеи": ["другими словами", "иными словами", "то есть", "а именно", "проще говоря", "говоря иначе", "можно сказать", "иначе говоря"],
    "избыточные_объяснения": ["как известно", "само собой разумеется", "очевидно что", "понятно что", "не нужно объяснять", "всем ясно", "не секрет", "ни для кого не секрет"],
    "дублирование_действий": ["опять", "снова", "еще раз", "повторно", "опять же", "по-прежнему", "как и прежде", "как обычно", "как всегда"],
}

KEYWORD_STOPS = "что как это все для она они его был была были есть может быть сказал сказала один одна тот том той тем при над под без через".split()

SPEECH_EMOTIONS = {
    "радость": ["ха-ха", "хи-хи", "ого", "ура", "прекрасно", "замечательно", "отлично"],
    "грусть": ["ох", "ах", "увы", "печально", "грустно", "жаль"],
    "удивление": ["что?", "как?", "неужели", "невероятно", "ого", "ба"],
    "гнев": ["черт", "дьявол", "проклятье", "ненавижу", "бесит", "злит"],
    "страх": ["боже", "ужас", "страшно", "боюсь", "кошмар"],
    "сомнение": ["может", "возможно", "наверное", "вроде", "похоже"],
}

SPEECH_FEATURES = {
    "формальность": ["господин", "госпожа", "уважаемый", "позвольте", "извините"],
    "разговорность": ["ну", "вот", "типа", "короче", "слушай", "блин"],
    "архаизмы": ["сие", "оно", "дабы", "коли", "ежели", "посему"],
    "просторечие": ["чё", "шо", "када", "тады", "энтот"],
}

AUTHOR_VERBS = """сказал сказала произнес произнесла ответил ответила спросил спросила воскликнул воскликнула проговорил проговорила пробормотал
пробормотала прошептал прошептала крикнул крикнула заметил заметила добавил добавила продолжил продолжила уточнил уточнила промолвил
промолвила буркнул буркнула бросил бросила выпалил выпалила""".split()
