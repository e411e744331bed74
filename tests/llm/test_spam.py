import numpy as np

from docloom.llm import spam as S

PROSE = "The controller compares the mount with the one it stored before the rollout starts. If the queue is empty, an administrator may delete the token. "
ZH = "请注意，控制器会把快照写入新的索引器，因为旧的缓存在升级之后不可用。如果节点处于异常状态，调度器会跳过它。"
GOOD = [
    PROSE * 3, ZH * 4, "# Index\n" + "\n".join(f"* [x{i}](https://a.test/{i}/) The entry explains how the probe reaches the proxy after a restart." for i in range(8)),
    "```yaml\n" + "kind: Pod\nname: x\n" * 30 + "```\n" + PROSE, "\n".join(f"2025-01-01T10:00:{i:02d}Z WARN proxy[{i}]: retry {i}" for i in range(40)),
    "\n".join(f"| field{i} | string | The name of the field that holds it. |" for i in range(30)), "【运行警报】\nResource: Pod a/b\nReason: X\nMessage: it failed\nState: N/A"]
BAD = [
    "cheap node | best token | " * 30, "低价令牌 | 优惠缓存 | 最佳网桥 | " * 20, "指标预算网桥队列指标预算指标预算网桥队列!" * 20, "\n".join(f"desk-lamp{i} - SKU {1000 + i} - grey {i}.99" for i in range(30)),
    "\n".join(f"[ANCHOR: a{i} page, HLINK: https://a{i}.test/]" for i in range(20)), "想要正规运维就找正规运维，正规运维首选x正规运维。没有正规运维就没有优惠边车，优惠边车离不开正规运维。" * 10,
    "No pod plan without node shop, no node shop without pod plan. Our pod plan beats any pod plan and any node shop. " * 8, " ".join(f"#tag-a{i} #item-b{i}" for i in range(40)), "ch​eap node · Cheap Node · ★cheap node · ch3ap n0de · " * 15]


def test_share_by_kind():
    assert all(S.spam_share(t) < 0.5 for t in GOOD), [round(S.spam_share(t), 2) for t in GOOD]
    assert all(S.spam_share(t) > S.SPAM_SHARE for t in BAD), [round(S.spam_share(t), 2) for t in BAD]
    assert S.spam_share("") == S.spam_share(" \n​") == 0.0


def test_model_prefers_prose():
    texts = [PROSE * 2, ZH * 2] * 20
    n, kind, _ = S.Classifier()(texts)
    unit, first = S.units(n, kind)
    prose = S.is_prose(kind, first)
    costs = S.log_costs(np.bincount(S.trigrams(kind, first)[prose[unit]], minlength=S.C**3))
    mean = lambda t: S._surprisal(*S.Classifier()([t])[:2], costs)[2].mean()
    assert mean(PROSE) < mean(BAD[3]) and mean(ZH) < mean(BAD[1])
    assert abs(np.exp2(-costs.reshape(S.C, S.C, S.C)).sum(2) - 1).max() < 1e-6  # a distribution for every context


def test_query(spark):
    rows = [(i, t) for i, t in enumerate(GOOD * 8)] + [(1000 + i, t) for i, t in enumerate(BAD)] + [(2000, None), (2001, ""), (2002, "  \n"), (1000, BAD[0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, abnormal double")
    got = [r.doc_id for r in S.find_spam(df).collect()]
    assert sorted(got) == sorted([1000 + i for i in range(len(BAD))] + [1000])
    assert S.find_spam(df.limit(0)).count() == 0


def test_half_of_the_characters_is_the_limit(spark):
    """Bare links far from the prose and tags are counted exactly, so a page is a case as soon as they pass one half."""
    link = "https://shop.test/a/b/c\n"
    prose = "".join(f"The controller{i} compares mount {i} with the one it stored before rollout {i * i} starts, and then it waits for {i + 7} minutes. " for i in range(12))
    visible = sum(not c.isspace() for c in prose)
    page = lambda share: link * round(visible * share / (1 - share) / (len(link) - 1)) + "\n" + prose
    shares = [S.spam_share(page(x)) for x in (0.42, 0.56)]
    assert abs(shares[0] - 0.42) < 0.03 and abs(shares[1] - 0.56) < 0.03, shares
    df = spark.createDataFrame([(1, page(0.42)), (2, page(0.56))] + [(10 + i, PROSE * 3) for i in range(5)], "doc_id long, text string")
    assert [r.doc_id for r in S.find_spam(df).collect()] == [2]


def test_honest_sentences_are_no_list():
    """Short sentences with many marks are no items, nor is a refrain; stuffed lists with function words are."""
    assert S.spam_share("排空结束后，baulx 的两个副本共用一个边车；调度器最多重试 166 次。") == 0
    own = [
        "If the Job is stale, the mirror drops its image. ", "The upgrade from v2.17 took 33 minutes in edge. ", "v3.16 自带一个免费的证书工具，但是通知器最多重试 9 次。 ", "当租约耗尽时 kubelet 报告 ProbeWarning。 ",
        "Traffic moves to the next ReplicaSet after 49 hours. ", "新运维人员的培训从镜像层开始。 ", "Every Ingress writes its panel before a lease ends. ", "旧版控制器会自动忽略 mountPath。 "]
    refrain = "".join(x + "That also holds for yorrax. " for x in own)
    assert S.spam_share(refrain) < 0.5
    places = "Brackley Oakwell Thorncombe Westley Redcross Ferncross Redwell Brackfield Easthollow Redmere Highfield Millfen Ashwell Stonemoor Lowcross Northby".split()
    assert S.spam_share("；".join(f"预算通知器 in {x} (kelir-broker)" for x in places)) > S.SPAM_SHARE


def test_pages_that_look_half_normal_are_suspects(spark):
    """Stuffed sentences whose classes read like prose to the model are spam all the same, so the bar of the suspects is below one half."""
    prose = "".join(f"The controller{i} compares mount {i} with the one it stored before rollout {i * i} starts, and then it waits for {i + 7} minutes. " for i in range(9))
    plain = "The mirror is as the token was, and if the mount can, the probe will. " * 8
    tags = " ".join(f"#tag{i}-a{i * 7} #item{i}-b{i * 3}" for i in range(40))
    goods = "The lampshop is as the lampshop was, and if the lampshop can, the lampshop will. " * 6
    page = prose + "\n" + tags + "\n" + goods
    assert S.spam_share(page) > 0.52
    df = spark.createDataFrame([(1, page)] + [(10 + i, prose + plain) for i in range(30)], "doc_id long, text string")
    (found,) = S.suspects(df).filter("doc_id = 1").collect()
    assert 0.35 <= found.abnormal < 0.48
    assert [r.doc_id for r in S.find_spam(df).collect()] == [1]


def test_long_tokens_keep_their_length(spark):
    """A url of 3,000 characters outweighs 600 characters of prose."""
    page = PROSE * 4 + "\n\nhttps://shop.test/" + "cheapnode" * 333
    df = spark.createDataFrame([(1, page)] + [(10 + i, PROSE * 4) for i in range(20)], "doc_id long, text string")
    (n, _, size) = S._batch_arrays(S.sequences(df.filter("doc_id = 1")).select("key", "kinds", "sizes").toArrow().to_batches()[0])
    assert len(size) == n[0] and size.max() > 3000
    assert [r.doc_id for r in S.find_spam(df).collect()] == [1]


def test_bounds_end_a_look_only_where_it_makes_no_difference():
    """With a limit, pages above it have the very share; the others a bound that isn't above the limit either."""
    mixed = [a + "\n" + b for a in GOOD for b in BAD] + GOOD + BAD
    for t in mixed:
        whole, short = S.spam_share(t), S.spam_share(t, 0.5)
        assert (short == whole) if whole > 0.5 else (whole <= short <= 0.5)
