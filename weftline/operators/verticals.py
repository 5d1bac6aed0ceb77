"""Payloads of well-known sites to fields: declared as JSON paths and read with variants, so they stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {"s": "string", "l": "long", "b": "boolean", "j": "variant"}

#: For each extractor the URLs it takes and the fields of its payload, as name, JSON path and type (s string, l long, b boolean, j JSON) of each; the path is $ and the name where it isn't given.
_SPECS: dict[str, tuple[str, str]] = {
    "github_repo": (
        r"github\.com/[^/]+/[^/?#]+/?$",
        "owner=owner.login:s name:s full_name:s description:s homepage:s language:s topics:j license=license.spdx_id:s license_name=license.name:s default_branch:s stars=stargazers_count:l forks=forks_count:l watchers=subscribers_count:l "
        "open_issues=open_issues_count:l size_kb=size:l archived:b fork:b is_template:b has_issues:b has_wiki:b has_pages:b has_discussions:b created_at:s updated_at:s pushed_at:s html_url:s",
    ),
    "github_pr": (
        r"github\.com/[^/]+/[^/]+/pull/\d+",
        "number:l title:s body:s state:s draft:b merged:b merged_at:s merge_commit_sha:s author=user.login:s milestone=milestone.title:s head_ref=head.ref:s base_ref=base.ref:s head_sha=head.sha:s additions:l deletions:l changed_files:l commits:l "
        "comments:l review_comments:l created_at:s updated_at:s closed_at:s html_url:s",
    ),
    "github_issue": (r"github\.com/[^/]+/[^/]+/issues/\d+", "number:l title:s body:s state:s state_reason:s author=user.login:s milestone=milestone.title:s comments:l locked:b created_at:s updated_at:s closed_at:s html_url:s"),
    "github_release": (r"github\.com/[^/]+/[^/]+/releases/", "tag_name:s name:s body:s draft:b prerelease:b author=author.login:s created_at:s published_at:s html_url:s"),
    "pypi": (
        r"pypi\.org/project/",
        "name=info.name:s version=info.version:s summary=info.summary:s homepage=info.home_page:s license=info.license:s author=info.author:s author_email=info.author_email:s maintainer=info.maintainer:s requires_python=info.requires_python:s "
        "requires_dist=info.requires_dist:j keywords=info.keywords:s classifiers=info.classifiers:j yanked=info.yanked:b yanked_reason=info.yanked_reason:s project_urls=info.project_urls:j",
    ),
    "npm": (r"npmjs\.com/package/", "name:s description:s latest_version=['dist-tags'].latest:s homepage:s repository=repository.url:s keywords:j maintainers:j"),
    "crates_io": (
        r"crates\.io/crates/",
        "name=crate.id:s description=crate.description:s homepage=crate.homepage:s documentation=crate.documentation:s repository=crate.repository:s max_stable_version=crate.max_stable_version:s max_version=crate.max_version:s "
        "newest_version=crate.newest_version:s downloads=crate.downloads:l recent_downloads=crate.recent_downloads:l categories=crate.categories:j keywords=crate.keywords:j created_at=crate.created_at:s updated_at=crate.updated_at:s "
        "latest_release_date=versions[0].created_at:s latest_license=versions[0].license:s latest_rust_version=versions[0].rust_version:s latest_yanked=versions[0].yanked:b",
    ),
    "huggingface_dataset": (
        r"huggingface\.co/datasets/",
        "id:s private:b gated:s downloads:l downloads_all_time=downloadsAllTime:l likes:l tags:j license=cardData.license:s language=cardData.language:j task_categories=cardData.task_categories:j size_categories=cardData.size_categories:j "
        "annotations_creators=cardData.annotations_creators:j configs=cardData.configs:j created_at=createdAt:s last_modified=lastModified:s sha:s",
    ),
    "huggingface_model": (
        r"huggingface\.co/[^/]+/[^/?#]+/?$",
        "id:s model_id=modelId:s private:b gated:s downloads:l downloads_all_time=downloadsAllTime:l likes:l library_name:s pipeline_tag:s tags:j license=cardData.license:s language=cardData.language:j datasets=cardData.datasets:j "
        "base_model=cardData.base_model:j model_type=cardData.model_type:s created_at=createdAt:s last_modified=lastModified:s sha:s",
    ),
    "docker_hub": (r"hub\.docker\.com/", "namespace:s name:s pull_count:l star_count:l description:s full_description:s last_updated:s date_registered:s is_private:b status_description:s categories:j"),
    "dev_to": (
        r"dev\.to/[^/]+/",
        "id:l title:s description:s body_markdown:s url_canonical=canonical_url:s published_at:s edited_at:s reading_time_min=reading_time_minutes:l tags=tag_list:j positive_reactions=positive_reactions_count:l "
        "public_reactions=public_reactions_count:l comments_count:l page_views_count:l cover_image:s author_username=user.username:s author_name=user.name:s author_twitter=user.twitter_username:s author_github=user.github_username:s author_website=user.website_url:s",
    ),
    "stackoverflow": (
        r"stackoverflow\.com/questions/",
        "question_id=items[0].question_id:l title=items[0].title:s body=items[0].body:s tags=items[0].tags:j score=items[0].score:l view_count=items[0].view_count:l answer_count=items[0].answer_count:l is_answered=items[0].is_answered:b "
        "accepted_answer_id=items[0].accepted_answer_id:l creation_date=items[0].creation_date:l last_activity_date=items[0].last_activity_date:l author=items[0].owner.display_name:s author_rep=items[0].owner.reputation:l link=items[0].link:s",
    ),
    "hackernews": (r"news\.ycombinator\.com/item", "id:l type:s title:s url:s author:s points:l text:s created_at:s created_at_unix=created_at_i:l"),
    "reddit": (
        r"reddit\.com/r/[^/]+/comments/",
        "title=[0].data.children[0].data.title:s author=[0].data.children[0].data.author:s subreddit=[0].data.children[0].data.subreddit_name_prefixed:s selftext=[0].data.children[0].data.selftext:s url=[0].data.children[0].data.url_overridden_by_dest:s "
        "score=[0].data.children[0].data.score:l permalink=[0].data.children[0].data.permalink:s created_utc=[0].data.children[0].data.created_utc:l num_comments=[0].data.children[0].data.num_comments:l",
    ),
    "shopify_product": (r"/products/[^/?#]+", "id:l title:s handle:s vendor:s product_type:s tags:j variants:j images:j description:s"),
    "shopify_collection": (r"/collections/[^/?#]+", "products:j"),
    "instagram_profile": (
        r"instagram\.com/[^/]+/?$",
        "username=data.user.username:s user_id=data.user.id:s full_name=data.user.full_name:s biography=data.user.biography:s biography_links=data.user.bio_links:j external_url=data.user.external_url:s category=data.user.category_name:s "
        "follower_count=data.user.edge_followed_by.count:l following_count=data.user.edge_follow.count:l post_count=data.user.edge_owner_to_timeline_media.count:l is_verified=data.user.is_verified:b is_private=data.user.is_private:b "
        "is_business=data.user.is_business_account:b is_professional=data.user.is_professional_account:b recent_posts=data.user.edge_owner_to_timeline_media.edges:j",
    ),
    "youtube_video": (
        r"youtube\.com/watch",
        "video_id=videoDetails.videoId:s title=videoDetails.title:s description=videoDetails.shortDescription:s author=videoDetails.author:s channel_id=videoDetails.channelId:s channel_url=microformat.playerMicroformatRenderer.ownerProfileUrl:s "
        "view_count=videoDetails.viewCount:l length_seconds=videoDetails.lengthSeconds:l is_live=videoDetails.isLiveContent:b is_private=videoDetails.isPrivate:b is_unlisted=microformat.playerMicroformatRenderer.isUnlisted:b "
        "allow_ratings=videoDetails.allowRatings:b category=microformat.playerMicroformatRenderer.category:s upload_date=microformat.playerMicroformatRenderer.uploadDate:s publish_date=microformat.playerMicroformatRenderer.publishDate:s "
        "keywords=videoDetails.keywords:j thumbnails=videoDetails.thumbnail.thumbnails:j",
    ),
}
#: Extractors of broad paths, which only run when asked for.
EXPLICIT = ("shopify_product", "shopify_collection")


def _fields(spec: str) -> dict[str, tuple[str, str]]:
    out = {}
    for word in spec.split():
        name, kind = word.rsplit(":", 1)
        name, _, path = name.partition("=")
        path = path or name
        out[name] = (f"${path}" if path.startswith("[") else f"$.{path}", _KINDS[kind])
    return out


#: The same as a table: URL pattern, and path and type by field.
VERTICALS: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {name: (pattern, _fields(spec)) for name, (pattern, spec) in _SPECS.items()}


def _array(payload: Column, path: str, item: str) -> Column:
    """A list of a payload; empty where there is none."""
    return F.coalesce(F.from_json(F.get_json_object(payload, path), f"array<{item}>"), F.array().cast(f"array<{item}>"))


def _names(payload: Column, path: str, field: str) -> Column:
    return F.filter(F.transform(_array(payload, path, f"struct<{field}:string>"), lambda x: x[field]), lambda x: x.isNotNull())


def _repository(url: Column) -> dict[str, Column]:
    part = lambda k: F.nullif(F.regexp_extract(url, r"github\.com/([^/]+)/([^/?#]+)", k), F.lit(""))
    return {"owner": part(1), "repo": part(2)}


def _pypi(url: Column, payload: Column) -> dict[str, Column]:
    releases = F.from_json(F.get_json_object(payload, "$.releases"), "map<string,array<struct<upload_time:string>>>")
    version = F.get_json_object(payload, "$.info.version")
    classifiers = _array(payload, "$.info.classifiers", "string")
    return {
        "license_classifier": F.try_element_at(F.filter(classifiers, lambda c: c.startswith("License ::")), F.lit(1)),
        "release_count": F.coalesce(F.size(releases), F.lit(0)),
        "latest_release_date": F.try_element_at(F.try_element_at(releases, version), F.lit(1))["upload_time"],
    }


def _npm(url: Column, payload: Column) -> dict[str, Column]:
    latest = F.try_variant_get(F.try_parse_json(payload), "$['dist-tags'].latest", "string")
    manifests = F.from_json(F.get_json_object(payload, "$.versions"), "map<string,struct<license:string,deprecated:string,dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>>")
    own = F.try_element_at(manifests, latest)
    times = F.from_json(F.get_json_object(payload, "$.time"), "map<string,string>")
    return {
        "license": own["license"], "deprecated": own["deprecated"], "dependencies": own["dependencies"], "dev_dependencies": own["devDependencies"], "peer_dependencies": own["peerDependencies"],
        "release_count": F.coalesce(F.size(manifests), F.lit(0)), "latest_release_date": F.try_element_at(times, latest),
    }


def _answers(payload: Column) -> Column:
    item = "struct<answer_id:long,is_accepted:boolean,score:long,body:string,creation_date:long,last_edit_date:long,owner:struct<display_name:string,reputation:long>>"
    return _array(payload, "$.items", item)


def _files(url: Column, payload: Column) -> dict[str, Column]:
    files = _names(payload, "$.siblings", "rfilename")
    return {"file_count": F.size(_array(payload, "$.siblings", "struct<rfilename:string>")), "files": files}


#: Fields that aren't a single path of the payload.
_DERIVED: dict[str, Callable[[Column, Column], dict[str, Column]]] = {
    "github_pr": lambda u, p: _repository(u) | {"labels": _names(p, "$.labels", "name")},
    "github_issue": lambda u, p: _repository(u) | {"labels": _names(p, "$.labels", "name"), "assignees": _names(p, "$.assignees", "login")},
    "github_release": lambda u, p: _repository(u) | {"asset_count": release_assets(p)["assets"], "total_downloads": release_assets(p)["downloads"]},
    "pypi": _pypi,
    "npm": _npm,
    "crates_io": lambda u, p: {"release_count": F.size(_array(p, "$.versions", "struct<num:string>"))},
    "huggingface_model": _files,
    "huggingface_dataset": _files,
    "docker_hub": lambda u, p: {"full_name": F.concat_ws("/", F.get_json_object(p, "$.namespace"), F.get_json_object(p, "$.name")), "is_official": F.get_json_object(p, "$.namespace") == "library"},
    "shopify_product": lambda u, p: {"variant_count": F.size(_array(p, "$.variants", "struct<id:long>"))},
    "shopify_collection": lambda u, p: {"api_url": F.concat(F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), "/+$", ""), F.lit("/products.json")), "product_count": F.size(_array(p, "$.products", "struct<id:long>"))},
}


def vertical_of(url: Column) -> Column:
    """The first extractor that takes a URL, explicit ones aside; null where none does."""
    out = F.lit(None).cast("string")
    for name, (pattern, _) in reversed(VERTICALS.items()):
        if name not in EXPLICIT:
            out = F.when(url.rlike(rf"^https?://(?:[\w-]+\.)*{pattern}"), name).otherwise(out)
    return out


def extract_vertical(df: DataFrame, name: str, payload: str = "payload", url: str = "url") -> DataFrame:
    """*df* with a struct column *name* of the extractor's fields; a payload that doesn't parse gives nulls."""
    if name not in VERTICALS:
        raise ValueError(f"unknown extractor: {name}")
    data = F.try_parse_json(payload)
    field = lambda path, kind: F.to_json(F.try_variant_get(data, path, "variant")) if kind == "variant" else F.try_variant_get(data, path, kind)
    columns = [field(path, kind).alias(n) for n, (path, kind) in VERTICALS[name][1].items()]
    site = F.col(url) if url in df.columns else F.lit(None).cast("string")
    columns += [c.alias(n) for n, c in _DERIVED.get(name, lambda u, p: {})(site, F.col(payload)).items()]
    return df.withColumn(name, F.struct(*columns))


def payload_of(name: str, text: Column, number: Column, flag: Column) -> Column:
    """A payload of an extractor that holds *text*, *number* and *flag* wherever it reads a string, a whole number or a boolean: its round trip."""
    tree: dict = {}
    for path, kind in VERTICALS[name][1].values():
        value = {"string": text, "long": number, "boolean": flag}.get(kind)
        steps = re.findall(r"\['([^']+)'\]|\[(\d+)\]|([A-Za-z_][\w]*)", path)
        if value is None:
            continue
        node = tree
        for i, (quoted, index, plain) in enumerate(steps):
            step = int(index) if index else quoted or plain
            if i + 1 == len(steps):
                node[step] = value
            else:
                node = node.setdefault(step, {})

    def build(node: dict | Column) -> Column:
        if not isinstance(node, dict):
            return node
        if any(isinstance(k, int) for k in node):
            return F.array(*[build(node[k]) for k in sorted(node)])
        return F.struct(*[build(v).alias(k) for k, v in node.items()])

    return F.to_json(build(tree))


def release_assets(payload: Column) -> Column:
    """Number of assets of a release and their downloads in all."""
    assets = F.from_json(F.get_json_object(payload, "$.assets"), "array<struct<name:string,download_count:long>>")
    return F.struct(F.coalesce(F.size(assets), F.lit(0)).alias("assets"), F.coalesce(F.aggregate(assets, F.lit(0).cast("long"), lambda s, a: s + F.coalesce(a["download_count"], F.lit(0))), F.lit(0)).alias("downloads"))


def accepted_answer(payload: Column) -> Column:
    """The first accepted answer of a list of answers; null without one."""
    return F.try_element_at(F.filter(_answers(payload), lambda a: a["is_accepted"]), F.lit(1))


def top_answers(payload: Column) -> Column:
    """All answers of a list, with author and reputation, in the order given."""
    return F.transform(_answers(payload), lambda a: F.struct(a["answer_id"].alias("answer_id"), a["is_accepted"].alias("is_accepted"), a["score"].alias("score"), a["body"].alias("body"), a["owner"]["display_name"].alias("author"), a["owner"]["reputation"].alias("author_rep")))


# -- records of note and bookmark services ------------------------------------

def bookmarks(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Bookmark records (url, title, description, notes, tag_names) as documents."""
    r = F.from_json(payload, "struct<id:long,url:string,title:string,description:string,notes:string,tag_names:array<string>,date_modified:string>")
    d = df.select(r.alias("r"))
    return d.select(F.col("r.url").alias("url"), F.col("r.title").alias("title"), F.concat_ws("\n\n", "r.description", "r.notes").alias("markdown"), F.lit("mcp").alias("source_type"), F.col("r.tag_names").alias("technologies"), F.col("r.id").cast("string").alias("external_id"))


def snippets(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Snippet records with fragments as documents of fenced code."""
    r = F.from_json(payload, "struct<id:long,title:string,description:string,categories:array<string>,fragments:array<struct<file_name:string,code:string,language:string>>>")
    fenced = F.transform("r.fragments", lambda f: F.concat(F.lit("### "), F.coalesce(f["file_name"], F.lit("fragment")), F.lit("\n\n```"), F.coalesce(f["language"], F.lit("")), F.lit("\n"), F.coalesce(f["code"], F.lit("")), F.lit("\n```")))
    return df.select(r.alias("r")).select(F.col("r.title").alias("title"), F.concat_ws("\n\n", "r.description", F.array_join(fenced, "\n\n")).alias("markdown"), F.lit("mcp").alias("source_type"), F.col("r.categories").alias("technologies"), F.col("r.id").cast("string").alias("external_id"))


def papers(df: DataFrame, tags: DataFrame, people: DataFrame, key: str = "id") -> DataFrame:
    """Scanned papers (id, title, content, tags array<long>, correspondent) with the names of their tags (inner, in order) and correspondent (left)."""
    named = df.select(key, F.posexplode("tags").alias("pos", "tag")).join(tags.select(F.col("id").alias("tag"), F.col("name").alias("tag_name")), "tag").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tag_name"))).alias("t"))  # bounded by one paper's tags
    out = df.join(named, key, "left").join(people.select(F.col("id").alias("correspondent"), F.col("name").alias("author")), "correspondent", "left")
    return out.select(key, "title", F.col("content").alias("markdown"), "author", F.coalesce(F.transform("t", lambda x: x["tag_name"]), F.array().cast("array<string>")).alias("technologies"), F.lit("mcp").alias("source_type"))
